"""Links among the members of shared buckets, offered along stars and lost nowhere.

Each bucket offers edges from one hub to its other members. Confirmed edges give components;
buckets whose members still lie in several of them offer stars round the best-linked member. What
is left after that are mostly buckets of members that share a common passage and little else.
Their sets are cut to the rarest quarter of their elements, of which two sets as similar as asked
for must share one, and members of different components meet by these elements, unless the
elements that nobody else holds already rule a link out. So a bucket of n members costs n edges, a
common passage brings nobody together, and no link is given up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.llm.components import components
from facetlake.llm.scratch import small, stored
from facetlake.llm.shingles import mix

# Counts of elements are kept for so many slots, whatever the number of elements.
SLOT_BITS = 21

# Over two row aliases: whether the rows may link, and how unlike they look.
Relation = Callable[[str, str], Column]
# From edges, the table of sets and the percentage asked for: the edges that hold.
Confirmation = Callable[[DataFrame, DataFrame, int], DataFrame]


def _labelled(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of the buckets that still hold several components, with ``c``, their component."""
    if labels is None:
        return shared.withColumn("c", F.col("id"))
    named = shared.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "c", F.coalesce("component", "id")).drop("component")
    mixed = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where(
        "c0 <> c1").select("key")
    return named.join(mixed, "key")


def _star(rows: DataFrame, hub: Column, may_link: Relation, unlike: Relation) -> DataFrame:
    """``a, b, unlike``: edges from the row of each bucket with the least ``hub`` to the
    bucket's rows in other components, where they may link."""
    hubs = rows.groupBy("key").agg(F.min(hub).alias("hub")).select(
        "key", F.col("hub.id").alias("hub"))
    wide = rows.drop("key", "rank").distinct()
    chosen = hubs.join(wide.withColumnRenamed("id", "hub"), "hub")
    pairs = rows.alias("x").join(chosen.alias("h"), "key").where(
        (F.col("x.c") != F.col("h.c")) & may_link("x", "h"))
    return pairs.select(
        F.least("x.id", "h.hub").alias("a"), F.greatest("x.id", "h.hub").alias("b"),
        unlike("x", "h").alias("unlike"),
    ).distinct()


def _slots(elements: np.ndarray) -> np.ndarray:
    return (mix(elements.view(np.uint64)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _element_counts(sets: DataFrame) -> np.ndarray:
    """How many ``members`` of all sets fall into each of 2^``SLOT_BITS`` slots: 16 MiB, summed up
    on the executors. An element that several sets hold has two at least."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in batches:
            flat = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False)
            counts += np.bincount(_slots(flat), minlength=len(counts))
        filled = np.flatnonzero(counts)
        for at in range(0, len(filled), 100_000):
            part = filled[at:at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(counts[part])], names=["slot", "n"])

    rows = sets.select("members").mapInArrow(partial, "slot long, n long").groupBy("slot").agg(
        F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return counts


def rarest_elements(sets: DataFrame, percent: int) -> DataFrame:
    """``id, n, key, left``: the elements that a set must share one of with any set as
    similar as ``percent``, the rarest ``n - ceil(n * percent / 100) + 1`` of its ``n``.

    Any order that all sets follow is good for that; here it is the count of an element's slot,
    then the element. Elements that no other of the ``sets`` can hold are left out, and ``left``
    counts the others of the whole set from the key on, which bounds what it can share if the key
    is the first shared one: keys with too few are left out.
    """
    counts = sets.sparkSession.sparkContext.broadcast(_element_counts(sets))
    kind = sets.schema["id"].dataType.simpleString()

    def chosen(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        often = counts.value[_slots(members)]
        order = np.lexsort((members, often))
        held = often[order] > 1
        n = len(members)
        head = n - -(-n * percent // 100) + 1
        left = held[::-1].cumsum()[::-1]
        keep = held[:head] & (100 * left[:head] >= percent * n)
        return members[order][:head][keep], left[:head][keep]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            found = [chosen(x.values.to_numpy(zero_copy_only=False)) for x in lists]
            sizes = [len(keys) for keys, _ in found]
            flat = [np.concatenate([f[i] for f in found] or [[]]).astype(np.int64) for i in (0, 1)]
            owner = pa.array(np.repeat(np.arange(len(found)), sizes))
            counted = pa.array([len(x.values) for x in lists], pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(owner), counted.take(owner), pa.array(flat[0]),
                pa.array(flat[1].astype(np.int32)),
            ], names=["id", "n", "key", "left"])

    # No column of the sets but these two is read.
    return sets.select("id", "members").mapInArrow(rows, f"id {kind}, n int, key long, left int")


def _by_rare_elements(
    rows: DataFrame, sets: DataFrame, percent: int, may_link: Relation,
) -> DataFrame:
    """``a, b``: the pairs of different components in buckets of three or more that share a
    rare element and may link. Smaller buckets are fully tested by their stars.

    At the first element that two sets share, both must have enough others left; a pair may come
    up at later ones too."""
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 2").select(
        "key")
    members = stored(rows.join(crowded, "key").drop("key", "rank").distinct(), "star-crowded")
    rare = rarest_elements(sets.join(small(members.select("id").distinct(), 16), "id"), percent)
    met = stored(rare.withColumnRenamed("n", "_size").join(members, "id"), "star-rare")
    most = F.least("x.left", "y.left")
    return met.alias("x").join(met.alias("y"), "key").where(
        (F.col("x.id") < F.col("y.id")) & (F.col("x.c") != F.col("y.c"))
        & ((100 + percent) * most >= percent * (F.col("x._size") + F.col("y._size")))
        & may_link("x", "y")
    ).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``(a, b)`` of ``edges`` whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("mb"))
    both = F.size(F.array_intersect("ma", "mb"))
    return edges.join(left, "a").join(right, "b").select(
        "a", "b", both.alias("i"), (F.size("ma") + F.size("mb") - both).alias("u")
    ).where(100 * F.col("i") >= percent * F.col("u")).select("a", "b")


def linked(
    shared: DataFrame, sets: DataFrame, percent: int, may_link: Relation, unlike: Relation,
    name: str, holds: Confirmation = confirmed, rest: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``node, component`` of the members whose ``sets`` (stored: ``id, members``) are linked.

    ``shared`` (stored) holds ``key, id`` and what the relations need, one row for each bucket
    and member. Where ``sets`` hold something shorter that the members follow from, ``holds``
    confirms edges on it, and ``rest`` finds the links that stars leave open: from the rows of
    buckets with several components ``c`` to edges ``a, b`` that hold.
    """
    def confirm(edges: DataFrame) -> DataFrame:
        return holds(edges, sets, percent)

    # Each member's likeliest edge first: most groups are whole after that.
    star = stored(_star(_labelled(shared, None), F.struct("id"), may_link, unlike),
                  f"{name}-star")
    tested = stored(star.groupBy("b").agg(F.min(F.struct("unlike", "a")).alias("e")).select(
        F.col("e.a").alias("a"), "b"), f"{name}-tested0")
    links = stored(confirm(tested), f"{name}-links0")
    labels = stored(components(links), f"{name}-labels0")
    for step in (1, 2):
        rows = stored(_labelled(shared, labels), f"{name}-mixed{step}")
        if rows.isEmpty():
            break
        if step == 1:
            degree = links.select("a").union(links.select("b")).toDF("id").groupBy("id").agg(
                F.count(F.lit(1)).alias("degree"))
            ranked = rows.join(degree, "id", "left").withColumn(
                "rank", -F.coalesce("degree", F.lit(0))).drop("degree")
            fresh = _star(rows, F.struct("id"), may_link, unlike).union(
                _star(ranked, F.struct("rank", "id"), may_link, unlike))
        elif rest is None:
            fresh = _by_rare_elements(rows, sets, percent, may_link)
        if step == 2 and rest is not None:
            more = stored(rest(rows), f"{name}-more{step}")
        else:
            fresh = stored(fresh.select("a", "b").join(
                tested, ["a", "b"], "left_anti").distinct(), f"{name}-fresh{step}")
            if fresh.isEmpty():
                continue
            more = stored(confirm(fresh), f"{name}-more{step}")
            tested = stored(tested.union(fresh), f"{name}-tested{step}")
        if more.isEmpty():
            continue
        links = stored(links.union(more), f"{name}-links{step}")
        labels = stored(components(links), f"{name}-labels{step}")
    return labels

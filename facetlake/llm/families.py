"""The links that stars leave open, found family by family.

A family is what shared buckets hold together: rows of different families share no bucket. The
members of a family are brought to one task, with the text that their sets follow from; in large
corpora chains of common passages make families without bounds, and one too large is taken bucket
by bucket. (A bucket too large for one task goes to one for each pair of its parts.) There they are
compared without a row for any pair: members with too many elements that nobody beside them holds
drop out, then pairs whose parities of 1024 ranges of elements differ in more places than two
similar sets can, and the full sets of the others are compared, until their components are one. So
what is moved and written grows with the members, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.llm.components import components
from facetlake.llm.scratch import small, stored
from facetlake.llm.shingles import mix

# Elements brought together: a larger family is taken by buckets, a larger bucket by parts.
PART = 1 << 20
PARITIES = 1024
# Members compared with all others at a time.
STEP = 256

# From texts, one after the other: their sorted distinct elements and how many each has.
Sets = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def _groups(rows: DataFrame, members: DataFrame, part: int) -> DataFrame:
    """``members`` (``id, n, c, family``) with ``grp`` for ``family``: those compared with each
    other. Of a large family a member has one row for each of its buckets in ``rows``."""
    weights = stored(members.groupBy("family").agg(F.sum("n").alias("weight")), "family-weights")
    large = weights.where(F.col("weight") > part).select("family")
    whole = members.join(large, "family", "left_anti").withColumnRenamed("family", "grp")
    single = rows.select(F.col("key").alias("grp"), "id").join(
        members.join(large, "family", "left_semi"), "id").drop("family")
    return whole.unionByName(single)


def _parts(groups: DataFrame, part: int) -> DataFrame:
    """``id, c, own`` of ``groups`` with ``pack``, the rows brought to one task, and the cells
    ``grp, low, high`` of it: the pairs of parts of a group. Groups of one part share packs."""
    weights = stored(groups.groupBy("grp").agg(F.sum("n").alias("weight")), "group-weights")
    total = weights.agg(F.sum("weight")).first()[0] or 0
    blocks = F.ceil(F.col("weight") / part).cast("int")
    dealt = groups.join(small(weights, 24), "grp").withColumn("blocks", blocks).withColumns({
        "own": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"),
        "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    cells = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    shared = F.pmod(F.xxhash64("grp"), F.lit(max(1, -(-total // part))))
    return cells.select("id", "c", "grp", "own", "low", "high", F.when(
        F.col("blocks") == 1, shared).otherwise(F.xxhash64("grp", "low", "high")).alias("pack"))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows equal in all columns begins, and the end."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _linked_rows(
    codes: np.ndarray, counts: np.ndarray, component: np.ndarray, side: np.ndarray, percent: int,
    mark: np.ndarray,
) -> Iterator[tuple[int, int]]:
    """Pairs of rows whose sets, ``codes`` one after the other, are similar enough: of any two
    components that such a pair joins at least a chain of pairs. If ``side`` is not 0, rows of
    one side are not compared. ``mark`` has room for every code."""
    m = len(counts)
    starts = np.cumsum(counts) - counts
    across = side.any()
    root = np.unique(component, return_inverse=True)[1]
    odd = np.bincount(np.repeat(np.arange(m) * PARITIES, counts) + codes % PARITIES,
                      minlength=m * PARITIES).reshape(m, PARITIES) & 1
    signs = (1 - 2 * odd).astype(np.float32)
    for at in range(0, m, STEP):
        apart = (PARITIES - signs[at:at + STEP] @ signs[at:].T) / 2
        both = counts[at:at + STEP, None] + counts[None, at:]
        maybe = apart <= both - 2 * -(-percent * both // (100 + percent))
        maybe &= root[at:at + STEP, None] != root[None, at:]
        if across:
            maybe &= side[at:at + STEP, None] != side[None, at:]
        for i in np.flatnonzero(maybe.any(axis=1)).tolist():
            x, others = at + i, at + i + 1 + np.flatnonzero(maybe[i, i + 1:])
            others = others[root[others] != root[x]]
            if not len(others):
                continue
            sizes = counts[others]
            begins = np.cumsum(sizes) - sizes
            where = np.arange(sizes.sum()) + np.repeat(starts[others] - begins, sizes)
            own = codes[starts[x]:starts[x] + counts[x]]
            mark[own] = 1
            shared = np.add.reduceat(mark[codes[where]], begins, dtype=np.int64)
            mark[own] = 0
            alike = 100 * shared >= percent * (counts[x] + sizes - shared)
            for y in others[alike].tolist():
                if root[y] != root[x]:
                    root[root == root[y]] = root[x]
                    yield x, y


def _compared(sets: Sets, percent: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("grp", "low", "high", "id")])
        ids, group, low, high, own, component = (
            rows[c].to_numpy() for c in ("id", "grp", "low", "high", "own", "c"))
        cells = _starts(group, low, high)
        cell = np.repeat(np.arange(len(cells) - 1), np.diff(cells))
        flat, counts = sets(rows["s"].to_pylist())
        # Elements of different cells are different: the mixing is one to one within a cell.
        salt = mix(cell.astype(np.uint64) + np.uint64(1))
        _, codes, often = np.unique(mix(flat.view(np.uint64) ^ np.repeat(salt, counts)),
                                    return_inverse=True, return_counts=True)
        ends = np.cumsum(counts)
        held = np.concatenate([[0], np.cumsum(often[codes] > 1)])
        live = 100 * (held[ends] - held[ends - counts]) >= percent * counts
        codes = codes[np.repeat(live, counts)]
        ids, low, high, own, component, counts, cell = (
            x[live] for x in (ids, low, high, own, component, counts, cell))
        ends = np.concatenate([[0], np.cumsum(counts)])
        # In a cell of two parts each is compared with the other alone.
        side = np.where(low == high, 0, own)
        mark = np.zeros(len(often), dtype=np.int8)
        found = [np.zeros((0, 2), dtype=np.int64)]
        cells = _starts(cell)
        if len(cells) > 1:
            least, most = (f.reduceat(component, cells[:-1]) for f in (np.minimum, np.maximum))
            for k in np.flatnonzero(least < most).tolist():
                begin, end = cells[k], cells[k + 1]
                some = slice(begin, end)
                pairs = list(_linked_rows(codes[ends[begin]:ends[end]], counts[some],
                                          component[some], side[some], percent, mark))
                if pairs:
                    found.append(ids[some][np.array(pairs)])
        a, b = np.concatenate(found).T
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def links_within(
    rows: DataFrame, texts: DataFrame, sets: Sets, percent: int, part: int = PART,
) -> DataFrame:
    """``a, b``: of the members of buckets of three or more, links that join all components which
    any two similar members of one bucket belong to. Smaller buckets are fully tested by stars.

    ``rows`` (stored) hold ``key, id, n, c``: the buckets that still have several components
    ``c``, and the size of each member's set; ``texts`` (stored) ``id, s`` what it is made of."""
    least = rows.groupBy("key").agg(F.min("c").alias("a"))
    families = components(rows.join(least, "key").where("a <> c").select("a", "c").distinct())
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 2").select(
        "key")
    rows = rows.join(crowded, "key")
    members = rows.select("id", "n", "c").distinct().join(
        families.select(F.col("node").alias("c"), F.col("component").alias("family")), "c")
    members = stored(members.select("id", "n", "c", "family"), "family-members")
    groups = stored(_groups(rows, members, part), "family-groups")
    return _parts(groups, part).join(texts, "id").groupBy("pack").applyInArrow(
        _compared(sets, percent), "a long, b long")

"""Links between documents.

``edges`` is ``src, rel, ref``; ``docs`` has ``id, item_type`` and the sort keys. A document
that very many others refer to makes the edge side of a join uneven; that side is the one that
adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.operators.numbering import global_positions
from facetlake.operators.sorting import sort_columns
from facetlake.plans.catalog import RelationSpec, SortSpec
from facetlake.session import lay_down

# Item types that are not records of their own.
CHILD_TYPES = ("note", "attachment")


def record_ids(docs: DataFrame) -> DataFrame:
    """Ids that may appear in a relation list."""
    return docs.filter(_is_record()).select("id")


def _is_record() -> Column:
    return ~F.coalesce(F.col("item_type").isin(*CHILD_TYPES), F.lit(False))


def related_forward(
    edges: DataFrame, docs: DataFrame, alternate_ids: DataFrame | None = None
) -> DataFrame:
    """``src, rel, id`` of the documents referred to, by id or alternate id."""
    records = record_ids(docs)
    names = records.select(F.col("id").alias("ref"), "id")
    if alternate_ids is not None:
        other = alternate_ids.join(records, "id", "left_semi")
        names = names.unionByName(other.select(F.col("alternate_id").alias("ref"), "id"))
    return edges.select("src", "rel", "ref").distinct().join(names, "ref").select(
        "src", "rel", "id"
    ).distinct()


def related_reverse(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """``src, rel, id`` of the documents referring to ``src``."""
    citing = edges.select(F.col("src").alias("id"), "rel", F.col("ref").alias("src")).distinct()
    return (
        citing.join(docs.select(F.col("id").alias("src")), "src", "left_semi")
        .join(record_ids(docs), "id", "left_semi")
        .select("src", "rel", "id")
    )


def related_undirected(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Both directions together.

    Both ends of a link are looked up once, and each direction is a projection of them.
    """
    known = docs.select("id", _is_record().alias("record"))
    ends = edges.select("src", "rel", "ref").join(
        known.select(F.col("id").alias("ref"), F.col("record").alias("to_record")), "ref").join(
        known.select(F.col("id").alias("src"), F.col("record").alias("from_record")), "src", "left")
    both = F.array(
        F.when(F.col("to_record"), F.struct("src", "rel", F.col("ref").alias("id"))),
        F.when(F.col("from_record"), F.struct(F.col("ref").alias("src"), "rel",
                                              F.col("src").alias("id"))))
    return ends.select(F.inline(F.array_compact(both))).distinct()


def related_limit(
    related: DataFrame, docs: DataFrame, order: Sequence[Column], k: int = 5
) -> DataFrame:
    """The first k related documents of each source, with their rank.

    The rank filter is applied within every partition before the shuffle.
    """
    window = Window.partitionBy("src", "rel").orderBy(*order)
    return (
        related.join(docs, "id")
        .withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= k)
    )


# A key with more than this part of all rows is heavy; so at most that many keys are.
HEAVY_PART = 200
# Tasks that the rows of a heavy key are dealt to.
SALTS = 64


# Hash slots in which keys are counted before any key is counted by itself.
SLOTS = 1 << 16


def heavy_keys(rows: DataFrame, on: Sequence[str], part: int = HEAVY_PART) -> DataFrame:
    """The keys that hold more than one row in ``part``: fewer than ``part`` rows, whatever the
    size of the table.

    Rows are counted by hash slot, which moves a bounded number of counts, and then only the keys
    of full slots by themselves. ``rows`` is read twice.
    """
    slot = F.pmod(F.xxhash64(*on), F.lit(SLOTS)).alias("_slot")
    slots = lay_down(rows.groupBy(slot).agg(F.count(F.lit(1)).alias("_n")))
    least = F.col("_n") * part > slots.agg(F.sum("_n").alias("n")).scalar()
    full = F.broadcast(slots.filter(least).select("_slot"))
    counts = rows.select(*on, slot).join(full, "_slot", "left_semi").groupBy(*on).agg(
        F.count(F.lit(1)).alias("_n"))
    return lay_down(counts.filter(least).select(*on))


def join_salted(
    many: DataFrame, few: DataFrame, on: Sequence[str], how: str = "inner",
    part: int = HEAVY_PART, salts: int = SALTS, heavy: DataFrame | None = None,
) -> DataFrame:
    """``many`` joined with ``few`` where some keys may hold a large part of ``many``.

    The rows of a heavy key are dealt to ``salts`` tasks, each with its own copy of the key's
    rows of ``few``; all other rows go the usual way. ``heavy`` lists those keys if known.
    """
    if heavy is None:
        heavy = heavy_keys(many, on, part)
    heavy = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
    drawn = F.pmod(F.xxhash64(*many.columns), F.lit(salts)).cast("int")
    left = many.join(heavy, list(on), "left").withColumn(
        "_salt", F.when(F.col("_heavy"), drawn).otherwise(0)).drop("_heavy")
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0)))
    right = few.join(heavy, list(on), "left").withColumn("_salt", F.explode(copies)).drop("_heavy")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def _links(ends: DataFrame, specs: Sequence[RelationSpec]) -> DataFrame:
    """``src, relation, id`` and the sort keys, both directions of all ends that have a list for
    them; the records listed are those with an entry."""
    forward = {s.key: s.key for s in specs}
    backward = {s.key: s.key if not s.directed else s.reverse_key for s in specs
                if not s.directed or s.reverse_key}

    def named(relations: dict[str, str]) -> Column:
        name = F.lit(None).cast("string")
        for key, list_name in relations.items():
            name = F.when(F.col("rel") == key, F.lit(list_name)).otherwise(name)
        return name

    both = F.array(
        F.struct("src", named(forward).alias("relation"), F.col("to_entry").alias("entry")),
        F.struct(F.col("to").alias("src"), named(backward).alias("relation"),
                 F.col("src_entry").alias("entry")))
    links = ends.select(F.inline(both)).filter("relation IS NOT NULL AND entry IS NOT NULL")
    return links.select("src", "relation", "entry.*")


def relations_of_records(
    edges: DataFrame, docs: DataFrame, alternate_ids: DataFrame, specs: Sequence[RelationSpec],
    sort: SortSpec, limit: int | None = None,
) -> DataFrame:
    """``src, relation, id, place``: the related records of every document by
    specification, in ``sort`` order, places from 1; with ``limit`` only the first ones. Both ends
    are known by id, or by alternate id where a specification says so; only records are listed.

    The entries of a list, an id with its sort keys, are found by the joins that look up the two
    ends; the lists then move once. A list may hold a large part of all records: those of the few
    documents with that many links are sorted by range, and a place is the distance from where
    the list begins.
    """
    known = [s.key for s in specs]
    by_alternate = [s.key for s in specs if s.match_alternate]
    # Read by both counts of keys and by the join.
    cited = lay_down(edges.filter(F.col("rel").isin(known)).select("src", "rel", "ref"))
    own = docs.select("id", F.when(_is_record(), F.struct("id", *sort.columns)).alias("entry"))
    names = own.select(F.col("id").alias("ref"), F.col("id").alias("to"),
                       F.col("entry").alias("to_entry"), F.lit(False).alias("other")).unionByName(
        alternate_ids.join(own, "id").select(
            F.col("alternate_id").alias("ref"), F.col("id").alias("to"),
            F.col("entry").alias("to_entry"), F.lit(True).alias("other")))
    heavy_refs, heavy_srcs = heavy_keys(cited, ["ref"]), heavy_keys(cited, ["src"])
    ends = join_salted(cited, names, ["ref"], heavy=heavy_refs).filter(
        ~F.col("other") | F.col("rel").isin(by_alternate)).select("src", "rel", "to", "to_entry")
    ends = lay_down(join_salted(
        ends, own.select(F.col("id").alias("src"), F.col("entry").alias("src_entry")), ["src"],
        heavy=heavy_srcs))
    links = _links(ends, specs)
    order = sort_columns(sort)

    # The documents with long lists: those that hold a large part of the references.
    long = names.join(F.broadcast(heavy_refs), "ref", "left_semi").select(
        F.col("to").alias("src")).unionByName(heavy_srcs).distinct()
    long = lay_down(long)
    window = Window.partitionBy("src", "relation").orderBy(*order)
    usual = links.join(long, "src", "left_anti").repartition("src", "relation")
    short = usual.distinct().withColumn("place", F.row_number().over(window))
    if limit is not None:
        short = short.filter(F.col("place") <= limit)
    columns = ["src", "relation", "id"]
    short = short.select(*columns, F.col("place").cast("bigint").alias("place"))
    if long.isEmpty():
        return short
    placed = global_positions(links.join(long, "src", "left_semi").distinct(),
                              [F.col("src"), F.col("relation"), *order], "_at")
    # Laid down like the documents of long lists, so their size decides how they are joined.
    begins = lay_down(placed.groupBy("src", "relation").agg(F.min("_at").alias("_begin")))
    found = placed.join(begins, ["src", "relation"]).select(
        *columns, (F.col("_at") - F.col("_begin") + 1).alias("place"))
    return short.unionByName(found if limit is None else found.filter(F.col("place") <= limit))

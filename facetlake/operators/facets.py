"""Facet values and counts.

All facets of a search are unpivoted in one pass and counted in one aggregation, which is
combined before the shuffle. A tree facet needs nothing more: every prefix of a path is a
value of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.functions.paths import evaluate_once
from facetlake.functions.text import normalize_words
from facetlake.functions.values import any_of, boolean_label
from facetlake.operators.filters import facet_matches
from facetlake.operators.numbering import global_positions
from facetlake.operators.relations import CHILD_TYPES
from facetlake.plans.catalog import FacetSpec
from facetlake.session import lay_down

ENTRY = "array<struct<facet:string,value:string,label:string>>"


def _entry(spec: FacetSpec, value: Column, label: Column) -> Column:
    return F.struct(
        F.lit(spec.key).alias("facet"),
        value.cast("string").alias("value"),
        label.cast("string").alias("label"),
    )


def _one(spec: FacetSpec, v: Column) -> Column:
    if spec.kind == "boolean":
        return _entry(spec, F.when(v, F.lit("t")).otherwise(F.lit("f")), boolean_label(v))
    if spec.kind == "labelled":
        return _entry(spec, v["value"], v["label"])
    if spec.kind == "path":
        path = v["path"] if spec.labelled_path else v
        if spec.labelled_path:
            label = v["label"]
        elif spec.path_label:
            label = spec.path_label(path)
        else:
            label = F.element_at(path, -1)
        return _entry(spec, F.array_join(path, spec.path_separator), label)
    return _entry(spec, v, v)


def facet_entries(spec: FacetSpec) -> Column:
    """Distinct (facet, value, label) entries of one document, with the missing bucket."""
    c = F.col(spec.column)
    values = c if spec.multi else F.array_compact(F.array(c))
    entries = F.array_distinct(F.transform(values, lambda v: _one(spec, v)))
    entries = F.coalesce(entries, F.expr(f"CAST(array() AS {ENTRY})"))
    if spec.missing_label is None:
        return entries
    missing = F.array(_entry(spec, F.lit(None), F.lit(spec.missing_label)))
    return evaluate_once(
        entries, lambda e: F.when(F.size(e) == 0, missing).otherwise(e)
    )


def facet_values(df: DataFrame, specs: Sequence[FacetSpec], *keep: str) -> DataFrame:
    """One row per document and facet value."""
    every = F.concat(*[facet_entries(s) for s in specs])
    return df.select(*keep, F.explode(every).alias("entry")).select(*keep, "entry.*")


def facet_counts(df: DataFrame, specs: Sequence[FacetSpec]) -> DataFrame:
    """A1-A4: documents per value of every facet, over all rows of ``df``."""
    return facet_values(df, specs).groupBy("facet", "value", "label").agg(
        F.count(F.lit(1)).alias("count")
    )


def facet_tree(df: DataFrame, spec: FacetSpec) -> DataFrame:
    """A5: counts at every node with its parent and depth."""
    path = F.split(F.col("value"), f"\\Q{spec.path_separator}\\E")
    parent = F.array_join(F.slice(path, F.lit(1), F.size(path) - 1), spec.path_separator)
    return facet_counts(df, [spec]).select(
        "facet", "value", "label", "count",
        F.when(F.size(path) > 1, parent).alias("parent"),
        F.size(path).alias("depth"),
    )


def _is_active(specs: Sequence[FacetSpec], chosen: Mapping[str, Sequence[str]]) -> Column:
    conditions = []
    for spec in specs:
        for value in chosen.get(spec.filter_key, ()):
            same = F.coalesce(F.col("value"), F.lit("")) == F.lit(value)
            if spec.kind == "path" and value:
                below = F.startswith(
                    F.lit(value), F.concat(F.col("value"), F.lit(spec.path_separator))
                )
                same = same | F.coalesce(below, F.lit(False))
            conditions.append((F.col("facet") == spec.key) & same)
    return any_of(conditions)


def with_active(
    counts: DataFrame, specs: Sequence[FacetSpec], chosen: Mapping[str, Sequence[str]] | None
) -> DataFrame:
    """Flag the values being filtered on, and the ancestors of a chosen path."""
    return counts.withColumn("active", _is_active(specs, chosen or {}))


def active_facets(
    counts: DataFrame, specs: Sequence[FacetSpec], chosen: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Only the active values."""
    return with_active(counts, specs, chosen).filter("active")


def facets_when_empty(
    docs: DataFrame, specs: Sequence[FacetSpec], chosen: Mapping[str, Sequence[str]],
    records_only: bool = True,
) -> DataFrame:
    """For each active facet alone, counts of its active values over the rows it matches.

    One pass: a document contributes the entries of a facet only if it satisfies all chosen
    values of that facet; other facets and keywords play no role. Notes and attachments are not
    counted with ``records_only``.
    """
    if records_only and "item_type" in docs.columns:
        docs = docs.filter(~F.coalesce(F.col("item_type").isin(*CHILD_TYPES), F.lit(False)))
    used = [s for s in specs if chosen.get(s.filter_key)]
    if not used:
        # Nothing is being filtered on, so no value is active.
        return docs.sparkSession.createDataFrame(
            [], "facet string, value string, label string, count bigint, active boolean")
    parts = []
    for spec in used:
        matched = F.lit(True)
        for value in chosen[spec.filter_key]:
            matched = matched & facet_matches(spec, value)
        parts.append(
            F.when(matched, facet_entries(spec)).otherwise(F.expr(f"CAST(array() AS {ENTRY})"))
        )
    exploded = docs.select(F.explode(F.concat(*parts)).alias("entry")).select("entry.*")
    counts = exploded.groupBy("facet", "value", "label").agg(F.count(F.lit(1)).alias("count"))
    return active_facets(counts, used, chosen)


def facets_of_item(docs: DataFrame, specs: Sequence[FacetSpec], id_column: str) -> DataFrame:
    """A document's own facet values, with count zero."""
    return facet_values(docs, specs, id_column).withColumn("count", F.lit(0).cast("bigint"))


def tree_places(tree: DataFrame, spec: FacetSpec) -> DataFrame:
    """A5: a tree's nodes (with ``active``) and their ``place`` among the children of their
    parent, from 1, in the facet's order.

    All nodes are sorted by range, by parent first, so that a parent with very many children
    spans several tasks.
    """
    rows = tree.withColumn("_parent", F.coalesce("parent", F.lit("")))
    within = directed_order(spec) or [F.col("value").asc_nulls_last()]
    placed = global_positions(rows, [F.col("_parent"), *within], "_place")
    first = placed.groupBy("_parent").agg(F.min("_place").alias("_first"))
    return placed.join(first, "_parent").withColumn(
        "place", F.col("_place") - F.col("_first") + 1).select(*tree.columns, "place")


def facet_order(spec: FacetSpec) -> list[Column]:
    """Active first, missing label last, then the sort keys.

    A reversed facet sorts all of these columns descending.
    """
    if not spec.sort_by:
        return []
    no_label = F.coalesce(F.col("label"), F.lit("")) == ""
    keys = [~F.col("active"), ~no_label if spec.sort_reverse else no_label]
    for key in spec.sort_by:
        keys.append(-F.col("count") if key == "count" else
                    normalize_words(F.coalesce(F.col(key), F.lit(""))))
    return keys


def directed_order(spec: FacetSpec) -> list[Column]:
    """O9 with its direction, and the value as tie breaker."""
    keys = [k.desc() if spec.sort_reverse else k.asc() for k in facet_order(spec)]
    return [*keys, F.col("value").asc_nulls_last()] if keys else []


def ordered_facet(counts: DataFrame, spec: FacetSpec) -> DataFrame:
    """FK0: one facet's result rows in display order; needs the ``active`` column."""
    rows = counts.filter(F.col("facet") == spec.key)
    if spec.missing_label is None:
        rows = rows.filter(F.col("value").isNotNull())
    order = directed_order(spec)
    return rows.orderBy(*order) if order else rows


def limit_with_leeway(counts: DataFrame, specs: Sequence[FacetSpec]) -> DataFrame:
    """The first values of each facet in display order, or all if only a few are left over.

    The rank filter bounds every partition before the shuffle (per-group limit), so a facet
    with very many values never meets in one task; the totals come from a combined count.
    Facets that sort alike are ranked together.
    """
    # The documents are read once: ranks and totals below start from the laid down counts.
    counts = lay_down(counts)
    unlimited = [s.key for s in specs if not s.initial_limit]
    parts = [counts.filter(F.col("facet").isin(unlimited))] if unlimited else []
    limited = [s for s in specs if s.initial_limit]
    for sort_by, reverse in dict.fromkeys((s.sort_by, s.sort_reverse) for s in limited):
        group = [s for s in limited if (s.sort_by, s.sort_reverse) == (sort_by, reverse)]
        rows = counts.filter(F.col("facet").isin([s.key for s in group]))
        totals = rows.groupBy("facet").agg(F.count(F.lit(1)).alias("n_values"))
        order = directed_order(group[0]) or [F.col("value").asc_nulls_last()]
        window = Window.partitionBy("facet").orderBy(*order)
        most = max(s.initial_limit + s.initial_leeway for s in group)
        ranked = rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= most)
        shown = any_of(
            (F.col("facet") == s.key) & (
                (F.col("rank") <= s.initial_limit)
                | (F.col("n_values") <= s.initial_limit + s.initial_leeway)
            )
            for s in group
        )
        parts.append(ranked.join(totals, "facet").filter(shown).select(*counts.columns))
    return reduce(DataFrame.unionByName, parts)

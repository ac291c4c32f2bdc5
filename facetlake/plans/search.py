"""Faceted keyword search: one call, lazily evaluated results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.operators import facets as facet_ops
from facetlake.operators import filters as filter_ops
from facetlake.operators import sorting
from facetlake.operators.index_tables import TermIndex
from facetlake.operators.keywords import Expr, keyword_hits
from facetlake.operators.relations import CHILD_TYPES
from facetlake.plans.catalog import BadgeSpec, Catalog, FacetSpec, SortSpec
from facetlake.session import lay_down


@dataclass
class SearchResult:
    """Matching documents with their score; pages, totals and facets derive from them."""

    matched: DataFrame
    catalog: Catalog
    filters: Mapping[str, Sequence[str]]
    sort: SortSpec | None
    docs: DataFrame

    @cached_property
    def keys(self) -> DataFrame:
        """Ids, scores and sort keys of all matches, laid down by one run of the search."""
        columns = self.sort.columns if self.sort else ()
        return lay_down(self.matched.select(*dict.fromkeys(["id", "score", *columns])))

    def totals(self, page_length: int = 20) -> DataFrame:
        return sorting.result_totals(self.matched, page_length)

    def page(self, number: int = 1, length: int = 20) -> DataFrame:
        """O7 with W1; a number beyond the end gives the last page.

        The first page is one pass. Any other is found on ``keys``, and the documents are read
        for the ids of the page only, which reach the scan.
        """
        if number <= 1:
            rows = sorting.page(self.matched, self.sort, 1, length)
            return sorting.with_positions(rows, self.sort, 1, length)
        return self.later_page(number, length)

    def later_page(self, number: int, length: int = 20) -> DataFrame:
        """Any page, by ``keys``: for callers that need those too, the first one as well."""
        number = sorting.fit_page(self.keys.count(), number, length)
        return self._fetched(sorting.page(self.keys, self.sort, number, length), number, length)

    def _fetched(self, keys: DataFrame, number: int, length: int) -> DataFrame:
        """The documents of ``keys``, the rows of one page, in their order."""
        found = sorting.with_positions(keys, self.sort, number, length).select(
            "id", "score", "position")
        placed = found.collect()
        rows = self.keys.sparkSession.createDataFrame(placed, found.schema)
        wanted = self.docs.filter(F.col("id").isin([r["id"] for r in placed]))
        return wanted.join(F.broadcast(rows), "id").select(
            *self.matched.columns, "position").orderBy("position")

    def everything(self) -> DataFrame:
        return sorting.all_results(self.matched, self.sort)

    def at(self, position: int, expected_id=None) -> DataFrame:
        """As ``sorting.result_at``, with the document read last; no row beyond the end."""
        found = self._fetched(sorting.page(self.keys, self.sort, position, 1), position, 1)
        moved = F.lit(False) if expected_id is None else F.col("id") != F.lit(expected_id)
        return found.drop("position").withColumn("moved", moved)

    def facets(self, specs: Sequence[FacetSpec] | None = None) -> DataFrame:
        specs = list(specs or self.catalog.facets)
        counts = facet_ops.facet_counts(self.matched, specs)
        return facet_ops.with_active(counts, specs, self.filters)


def search(
    docs: DataFrame,
    index: TermIndex | None,
    catalog: Catalog,
    keywords: Expr | None = None,
    filters: Mapping[str, Sequence[str]] | None = None,
    sort: str | SortSpec | None = None,
    records_only: bool = True,
    **structured,
) -> SearchResult:
    """Documents matching keywords and filters.

    Filters only mask documents: they meet the keyword hits by id, after scoring. Without
    ``keywords`` no term table is looked at, and ``index`` may be None.
    ``structured`` takes ``all_values``, ``any_values``, ``ranges`` and ``rejected``.
    """
    rejected = dict(structured.pop("rejected", None) or {})
    if records_only:
        rejected["item_type"] = [*rejected.get("item_type", ()), *CHILD_TYPES]
    kept = filter_ops.apply_filters(
        docs, catalog.facets, filters, rejected=rejected, **structured
    )
    if keywords is None:
        matched = kept.withColumn("score", F.lit(0.0))
    else:
        matched = kept.join(keyword_hits(index, keywords, catalog.fields), "id")
    spec = catalog.sort(sort) if isinstance(sort, str) else sort
    return SearchResult(matched, catalog, filters or {}, spec, docs)


# Columns of a result list when none are named. Attachments are rows of their own,
# see ``result_items``.
RESULT_FIELDS = ("id", "bib", "coins", "data", "url")


def select_fields(
    df: DataFrame, keys: Sequence[str] = RESULT_FIELDS, extra: Sequence[str] = ()
) -> DataFrame:
    """P5, X-4: the requested columns that exist; unknown names are ignored."""
    return df.select(*[k for k in dict.fromkeys([*keys, *extra]) if k in df.columns])


def result_items(page_rows: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """P5: what belongs to the rows of a page: ``id, position, kind, place, child, label, value``.

    ``kind`` is ``cites`` (the record referred to), ``attachment`` (file name and media type),
    ``link`` (title and URL) or ``note`` (its text); ``place`` numbers a row's entries of a kind
    from 1, by ``child``. A page row without any has one row with a null ``kind``. The entries
    are rows, so a record with very many children is no problem; every child table is cut to the
    page's ids first.
    """
    page_ids = page_rows.select("id", "position")

    def own(name: str, key: str = "id") -> DataFrame:
        # A page is small: its ids are sent to the tasks that scan the children.
        return tables[name].withColumnRenamed(key, "id").join(
            F.broadcast(page_ids.select("id")), "id", "left_semi")

    def entries(rows: DataFrame, kind: str, child: Column, label: Column,
                value: Column) -> DataFrame:
        return rows.select("id", F.lit(kind).alias("kind"), child.alias("child"),
                           label.cast("string").alias("label"), value.alias("value"))

    none = F.lit(None).cast("string")
    every = entries(own("edges", "src").filter("rel = 'cites'").distinct(), "cites", F.col("ref"),
                    none, F.col("ref"))
    for more in (
        entries(own("attachments"), "attachment", F.col("child_key"), F.col("data.filename"),
                F.col("data.content_type")),
        entries(own("links"), "link", F.col("child_key"), F.col("title"), F.col("url")),
        entries(own("notes"), "note", F.col("child_key"), none, F.col("note")),
    ):
        every = every.unionByName(more)
    placed = every.withColumn(
        "place", F.row_number().over(Window.partitionBy("id", "kind").orderBy("child")))
    return page_ids.join(placed, "id", "left").select(
        "id", "position", "kind", "place", "child", "label", "value")


def badge_flags(df: DataFrame, badges: Sequence[BadgeSpec]) -> DataFrame:
    """One boolean column per badge, by weight."""
    for badge in sorted(badges, key=lambda b: b.weight):
        df = df.withColumn(badge.key, F.coalesce(badge.predicate(), F.lit(False)))
    return df

"""Order, pages and totals of results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.operators.numbering import global_positions
from facetlake.plans.catalog import SortSpec


def sort_columns(spec: SortSpec | None, id_column: str = "id") -> list[Column]:
    """The sort keys, then the id as tie breaker; no columns means relevance."""
    if spec is None or not spec.columns:
        return [F.col("score").desc(), F.col(id_column).asc()]
    keys = [
        F.col(c).desc() if descending else F.col(c).asc()
        for c, descending in zip(spec.columns, spec.directions(), strict=True)
    ]
    return [*keys, F.col(id_column).asc()]


def all_results(df: DataFrame, spec: SortSpec | None, id_column: str = "id") -> DataFrame:
    """Every row in order (a distributed sort; write it, do not collect it)."""
    return df.orderBy(*sort_columns(spec, id_column))


def result_totals(df: DataFrame, page_length: int) -> DataFrame:
    """Number of matches and of pages."""
    return df.agg(F.count(F.lit(1)).alias("item_count")).select(
        "item_count",
        F.ceil(F.col("item_count") / F.lit(page_length)).cast("bigint").alias("page_count"),
    )


def fit_page(item_count: int, number: int, length: int) -> int:
    """A page number beyond the end becomes the last page."""
    return max(1, min(number, math.ceil(item_count / length)))


# Up to this place a page is found by keeping the best rows of each task.
NEAR_PLACES = 1000


def page(
    df: DataFrame, spec: SortSpec | None, number: int, length: int, id_column: str = "id",
    item_count: int | None = None,
) -> DataFrame:
    """One page; with ``item_count`` known, a number beyond the end gives the last page.

    A deep page is cut from the rows sorted by range over the cluster: no task holds the rows
    before it.
    """
    if item_count is not None:
        number = fit_page(item_count, number, length)
    last = number * length
    order = sort_columns(spec, id_column)
    if last <= NEAR_PLACES:
        return df.orderBy(*order).offset(last - length).limit(length)
    placed = global_positions(df, order, "_place")
    return placed.filter(F.col("_place").between(last - length + 1, last)).orderBy("_place").drop(
        "_place")


def all_positions(
    df: DataFrame, spec: SortSpec | None, id_column: str = "id", name: str = "position"
) -> DataFrame:
    """Every row with its place in the order."""
    return global_positions(df, sort_columns(spec, id_column), name)


def with_positions(
    page_rows: DataFrame, spec: SortSpec | None, number: int, length: int, id_column: str = "id"
) -> DataFrame:
    """Absolute position of each row of a page. The window sees one page only."""
    window = Window.partitionBy(F.lit(number)).orderBy(*sort_columns(spec, id_column))
    return page_rows.withColumn(
        "position", F.row_number().over(window) + F.lit((number - 1) * length)
    )


def result_at(
    df: DataFrame, spec: SortSpec | None, position: int, expected_id=None, id_column: str = "id"
) -> DataFrame:
    """The n-th result, with a flag telling whether it still is the expected one."""
    found = page(df, spec, position, 1, id_column)
    moved = F.lit(False) if expected_id is None else F.col(id_column) != F.lit(expected_id)
    return found.withColumn("moved", moved)

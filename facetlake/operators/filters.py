"""Structured filters. They restrict rows and never change a score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.functions.paths import starts_with_path
from facetlake.functions.values import all_of, any_of
from facetlake.plans.catalog import FacetSpec

Values = Mapping[str, Sequence[Any]]


def _value_is(df: DataFrame, column: str, value: Any) -> Column:
    data_type = df.schema[column].dataType
    if isinstance(data_type, T.ArrayType):
        return F.array_contains(F.col(column), F.lit(value).cast(data_type.elementType))
    return F.col(column) == F.lit(value).cast(data_type)


def require_all(df: DataFrame, values: Values | None) -> DataFrame:
    """every known column must hold one of its values."""
    for column, accepted in (values or {}).items():
        if column in df.columns:
            df = df.filter(any_of(_value_is(df, column, v) for v in accepted))
    return df


def require_any(df: DataFrame, values: Values | None) -> DataFrame:
    """one flat disjunction over all (column, value) pairs; no pair matches no row."""
    if not values:
        return df
    pairs = [(c, v) for c, accepted in values.items() if c in df.columns for v in accepted]
    return df.filter(any_of(_value_is(df, c, v) for c, v in pairs))


def date_ranges(
    df: DataFrame, ranges: Mapping[str, tuple[datetime | None, datetime | None]] | None
) -> DataFrame:
    """inclusive ranges, open at either end; NULL fails."""
    for column, (start, end) in (ranges or {}).items():
        if column in df.columns:
            kept = F.col(column).isNotNull()
            if start is not None:
                kept = kept & (F.col(column) >= F.lit(start))
            if end is not None:
                kept = kept & (F.col(column) <= F.lit(end))
            df = df.filter(kept)
    return df


def reject_any(df: DataFrame, values: Values | None) -> DataFrame:
    """drop a row when any (column, value) pair matches; NULL passes."""
    for column, rejected in (values or {}).items():
        if column in df.columns:
            hit = any_of(_value_is(df, column, v) for v in rejected)
            df = df.filter(~F.coalesce(hit, F.lit(False)))
    return df


def facet_is_missing(spec: FacetSpec) -> Column:
    """F8: the row has no value in the facet."""
    c = F.col(spec.column)
    return F.coalesce(F.size(c) <= 0, F.lit(True)) if spec.multi else c.isNull()


def facet_matches(spec: FacetSpec, value: str) -> Column:
    """Exact value, path prefix by component, or missing for an empty value."""
    if value == "":
        return facet_is_missing(spec)

    def one(v: Column) -> Column:
        if spec.kind == "boolean":
            return v == F.lit(value.lower() in ("t", "true"))
        if spec.kind == "labelled":
            return v["value"] == value
        if spec.kind == "path":
            path = F.array(*[F.lit(p) for p in value.split(spec.path_separator)])
            return starts_with_path(v["path"] if spec.labelled_path else v, path)
        return v == value

    c = F.col(spec.column)
    return F.coalesce(F.exists(c, one) if spec.multi else one(c), F.lit(False))


def facet_condition(
    specs: Sequence[FacetSpec], chosen: Mapping[str, Sequence[str]] | None
) -> Column:
    """conjunction over all chosen values; unknown filter keys are ignored."""
    by_key = {s.filter_key: s for s in specs}
    return all_of(
        facet_matches(by_key[key], value)
        for key, values in (chosen or {}).items() if key in by_key
        for value in values
    )


def apply_filters(
    df: DataFrame,
    specs: Sequence[FacetSpec] = (),
    filters: Mapping[str, Sequence[str]] | None = None,
    all_values: Values | None = None,
    any_values: Values | None = None,
    ranges: Mapping[str, tuple[datetime | None, datetime | None]] | None = None,
    rejected: Values | None = None,
) -> DataFrame:
    """All structured filters of one search."""
    steps = (
        lambda d: require_all(d, all_values),
        lambda d: require_any(d, any_values),
        lambda d: date_ranges(d, ranges),
        lambda d: reject_any(d, rejected),
        lambda d: d.filter(facet_condition(specs, filters)) if filters else d,
    )
    return reduce(lambda d, step: step(d), steps, df)

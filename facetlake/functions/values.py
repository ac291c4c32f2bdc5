"""Generic value transforms: chains, merges, flags, links and JSON access."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetlake.functions.paths import none_if_empty
from facetlake.functions.text import is_blank

ColumnFunction = Callable[[Column], Column]


def first_non_null(*columns: Column) -> Column:
    """M1: first column with a value."""
    return F.coalesce(*columns)


def merge_values(*columns: Column) -> Column:
    """M2: one list of array columns and non-empty scalars wrapped by ``as_list``."""
    merged = F.flatten(F.array(*[F.coalesce(c, F.expr("CAST(array() AS array<string>)"))
                                 for c in columns]))
    return none_if_empty(merged)


def as_list(c: Column) -> Column:
    """A scalar as a list without NULL or empty text."""
    return F.filter(F.array(c), lambda v: v.isNotNull() & (v != ""))


def chain(*steps: ColumnFunction) -> ColumnFunction:
    """X-3: compose column functions; NULL input stays NULL."""
    def apply(c: Column) -> Column:
        return F.when(c.isNotNull(), reduce(lambda value, step: step(value), steps, c))
    return apply


def distinct_ordered(c: Column) -> Column:
    """Distinct elements in order of first occurrence."""
    return F.array_distinct(c)


def labelled(value: Column, label: Column) -> Column:
    """A facet value together with its label."""
    return F.struct(value.alias("value"), label.alias("label"))


def boolean_label(c: Column, yes: str = "yes", no: str = "no") -> Column:
    """Label of a boolean facet value."""
    return F.when(c, F.lit(yes)).otherwise(F.lit(no))


def has_url(c: Column) -> Column:
    """M4: whether a URL field is non-blank; never NULL."""
    return ~is_blank(c)


def doi_url(c: Column) -> Column:
    """Resolvable form of a DOI."""
    return F.when(c.rlike(r"(?i)^https?://"), c).otherwise(
        F.concat(F.lit("https://doi.org/"), c)
    )


def link_doi_lines(c: Column) -> Column:
    """Turn ``DOI: value`` lines of a text into links."""
    return F.regexp_replace(
        c,
        r"(?im)^(\s*DOI:\s*)(?!https?://)(\S+)\s*$",
        r'$1<a href="https://doi.org/$2">$2</a>',
    )


def url_host(c: Column) -> Column:
    """Host name in lower case; NULL without one."""
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def url_is_valid(c: Column) -> Column:
    """Whether scheme and host are present."""
    scheme = F.try_parse_url(c, F.lit("PROTOCOL"))
    return F.coalesce((scheme != "") & (url_host(c) != ""), F.lit(False))


def json_value(c: Column, key: str, data_type: str = "string") -> Column:
    """One key of a JSON text column."""
    return F.try_variant_get(F.try_parse_json(c), f"$.{key}", data_type)


def all_of(conditions: Iterable[Column]) -> Column:
    """Conjunction; true for no condition."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    """Disjunction; false for no condition."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))

"""Hierarchical values as arrays of components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def evaluate_once(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body(c)`` with ``c`` computed once, however often the body refers to it.

    Inside lambdas and conditional branches Spark does not share equal subexpressions, so a
    pattern search used several times there would run several times per row.
    """
    return F.get(F.transform(F.array(c), body), F.lit(0))


def none_if_empty(c: Column) -> Column:
    """An array, or NULL instead of an empty one."""
    return evaluate_once(c, lambda values: F.when(F.size(values) > 0, values))


def path_prefixes(path: Column) -> Column:
    """Every prefix of a path, shortest first."""
    def prefixes(p: Column) -> Column:
        every = F.transform(
            F.sequence(F.lit(1), F.size(p)), lambda n: F.slice(p, F.lit(1), n)
        )
        return F.when(F.size(p) > 0, every).otherwise(F.slice(F.array(p), 1, 0))

    return evaluate_once(path, prefixes)


def is_ancestor(ancestor: Column, descendant: Column) -> Column:
    """Proper prefix test on components."""
    return (F.size(descendant) > F.size(ancestor)) & (
        F.slice(descendant, F.lit(1), F.size(ancestor)) == ancestor
    )


def parent_path(path: Column) -> Column:
    """Path without its last component; NULL for a root."""
    return F.when(F.size(path) > 1, F.slice(path, F.lit(1), F.size(path) - 1))


def starts_with_path(path: Column, prefix: Column) -> Column:
    """A path filter matches a node and everything below it."""
    return F.slice(path, F.lit(1), F.size(prefix)) == prefix

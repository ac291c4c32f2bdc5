"""Tag conditions on an array column of tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetlake.functions.text import strip
from facetlake.functions.paths import none_if_empty
from facetlake.functions.values import all_of


def _patterns(patterns: str | Sequence[str] | None) -> list[str]:
    if not patterns:
        return []
    return [patterns] if isinstance(patterns, str) else list(patterns)


def _anchored(pattern: str) -> str:
    return rf"\A(?:{pattern})"


def tag_gate(
    tags: Column,
    include: str | Sequence[str] | None = None,
    exclude: str | Sequence[str] | None = None,
) -> Column:
    """Keep if every include pattern, and not every exclude pattern, matches some tag."""
    tags = F.coalesce(tags, F.expr("CAST(array() AS array<string>)"))

    def some(pattern: str) -> Column:
        return F.coalesce(
            F.exists(tags, lambda t: strip(F.coalesce(t, F.lit(""))).rlike(_anchored(pattern))),
            F.lit(False),
        )

    keep = all_of(some(p) for p in _patterns(include))
    excluded = _patterns(exclude)
    return keep & ~all_of(some(p) for p in excluded) if excluded else keep


def tag_filter(tags: Column, include: str = "", exclude: str = "") -> Column:
    """Trimmed, non-empty, distinct tags accepted by both patterns; NULL if none remain."""
    def accepted(tag: Column) -> Column:
        ok = tag != ""
        if include:
            ok = ok & tag.rlike(_anchored(include))
        if exclude:
            ok = ok & ~tag.rlike(_anchored(exclude))
        return ok

    kept = F.array_distinct(F.filter(F.transform(tags, lambda t: strip(t)), accepted))
    return none_if_empty(kept)

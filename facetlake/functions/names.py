"""Creator names: searchable, sortable and display forms.

A creator is a struct ``creatorType, firstName, lastName, name`` in the item's own order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetlake.functions.paths import evaluate_once, none_if_empty
from facetlake.functions.text import RECORD_SEPARATOR, sort_key_text, strip, strip_rich_text


def _clean(c: Column) -> Column:
    return strip(strip_rich_text(F.coalesce(c, F.lit(""))))


def _searchable(creator: Column) -> Column:
    whole = F.when(F.coalesce(creator["name"], F.lit("")) != "", _clean(creator["name"]))
    cleaned = F.struct(
        whole.alias("whole"), _clean(creator["firstName"]).alias("first"),
        _clean(creator["lastName"]).alias("last"),
    )

    def forms(c: Column) -> Column:
        first, last = c["first"], c["last"]
        both = (first != "") & (last != "")
        return F.array_compact(F.array(
            c["whole"],
            F.when(both, F.concat_ws(" ", first, last))
            .when(first != "", first)
            .when(last != "", last),
            F.when(both, F.concat_ws(", ", last, first)),
        ))

    return evaluate_once(cleaned, forms)


def creator_names(creators: Column) -> Column:
    """Every spelling of every creator as one multi-part text."""
    forms = none_if_empty(F.flatten(F.transform(creators, _searchable)))
    return F.array_join(forms, RECORD_SEPARATOR)


def primary_creators(creators: Column, type_order: Column) -> Column:
    """Creators of the first type, in the item type's order, that has any."""
    ranks = F.filter(
        F.transform(creators, lambda c: F.array_position(type_order, c["creatorType"])),
        lambda r: r > 0,
    )
    return evaluate_once(F.array_min(ranks), lambda best: F.filter(
        creators, lambda c: F.array_position(type_order, c["creatorType"]) == best
    ))


def creator_sort_key(creators: Column, type_order: Column) -> Column:
    """Sort text over the primary creators; parts and creators keep apart by fillers."""
    def key(creator: Column) -> Column:
        parts = F.array(*[
            sort_key_text(F.coalesce(creator[p], F.lit("")))
            for p in ("lastName", "firstName", "name")
        ])
        return F.array_join(F.filter(parts, lambda p: p != ""), " zzz ")

    return F.coalesce(
        F.array_join(F.transform(primary_creators(creators, type_order), key), " zzzzzz "),
        F.lit(""),
    )


def display_name(creator: Column) -> Column:
    """The single-field name, else last and first name."""
    parts = F.filter(
        F.array(strip(F.coalesce(creator["lastName"], F.lit(""))),
                strip(F.coalesce(creator["firstName"], F.lit("")))),
        lambda p: p != "",
    )
    return F.coalesce(creator["name"], F.array_join(parts, ", "))


def creator_display(creators: Column, creator_types: Column) -> Column:
    """Creators with display name and the localised label of their type."""
    def show(creator: Column) -> Column:
        matching = F.filter(
            creator_types, lambda t: t["creator_type"] == creator["creatorType"]
        )
        return F.struct(
            creator["creatorType"].alias("creatorType"),
            display_name(creator).alias("display"),
            F.get(matching, 0)["localized"].alias("label"),
        )

    return F.transform(creators, show)

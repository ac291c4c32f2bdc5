"""Lookups in small reference tables, one row per item type or key.

Per-type tables are combined into one row per type first. They are library constants; whether
they are broadcast is left to the size check of the optimiser.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions.text import normalize_words, strip


def type_labels(type_locale: DataFrame, locale: str) -> DataFrame:
    """``item_type, type_label`` in one locale."""
    return type_locale.filter(F.col("locale") == locale).select(
        "item_type", F.nullif(F.col("localized"), F.lit("")).alias("type_label")
    )


def title_fields(type_field: DataFrame) -> DataFrame:
    """The first field of each type is its title."""
    return type_field.groupBy("item_type").agg(F.min_by("field", "position").alias("title_field"))


def _ordered(rows: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("position", *columns)))
    picked = F.transform(pairs, lambda p: F.struct(*[p[c].alias(c) for c in columns]))
    return rows.groupBy("item_type").agg(picked.alias(name))


def field_catalog(type_field: DataFrame, type_field_locale: DataFrame, locale: str) -> DataFrame:
    """Ordered (field, locale, localized) list per type."""
    labels = type_field_locale.filter(F.col("locale") == locale)
    joined = type_field.join(labels, ["item_type", "field"])
    return _ordered(joined, ["field", "locale", "localized"], "item_fields")


def creator_type_catalog(
    type_creator: DataFrame, type_creator_locale: DataFrame, locale: str
) -> DataFrame:
    """Ordered creator types per item type, with labels."""
    labels = type_creator_locale.filter(F.col("locale") == locale)
    joined = type_creator.join(labels, ["item_type", "creator_type"])
    return _ordered(joined, ["creator_type", "locale", "localized"], "creator_types")


def creator_type_order(type_creator: DataFrame) -> DataFrame:
    """Creator type names per item type, primary first."""
    listed = _ordered(type_creator, ["creator_type"], "_types")
    return listed.select(
        "item_type", F.transform("_types", lambda t: t["creator_type"]).alias("type_order")
    )


def creator_types_present(catalog: Column, creators: Column) -> Column:
    """The catalogued creator types that the item uses."""
    used = F.transform(creators, lambda c: c["creatorType"])
    kept = F.filter(catalog, lambda t: F.array_contains(used, t["creator_type"]))
    return F.coalesce(kept, F.slice(catalog, 1, 0))


def reference_text(bib: DataFrame, style: str, locale: str) -> DataFrame:
    """Formatted reference of one style and locale per item."""
    return bib.filter((F.col("style") == style) & (F.col("locale") == locale)).select(
        "item_key", "bib"
    )


def export_formats(formats: DataFrame, names: Sequence[str]) -> DataFrame:
    """Stored export texts as one column per format."""
    return formats.groupBy("item_key").pivot("format", list(names)).agg(F.first("content"))


def collection_names(membership: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, name``: non-blank names of an item's live collections."""
    named = nodes.filter(~F.coalesce(F.col("trashed"), F.lit(False))).select(
        "key", strip(F.col("name")).alias("name")
    ).filter("name <> ''")
    return membership.select("id", "key").join(named, "key").select("id", "name")


def recorded_tags(item_tag: DataFrame) -> DataFrame:
    """``item_key, recorded_tags``: the distinct tags recorded for each item, in order.

    Repeated tags go before any row moves, so an item's group holds its distinct tags only.
    """
    return item_tag.select("item_key", "tag").distinct().groupBy("item_key").agg(
        F.sort_array(F.collect_list("tag")).alias("recorded_tags"))


def tags_of_items(item_tags: DataFrame, items: DataFrame) -> DataFrame:
    """Items (``id``) with the distinct tags recorded for them."""
    tags = recorded_tags(item_tags.withColumnRenamed("id", "item_key"))
    return items.join(
        tags.select(F.col("item_key").alias("id"), F.col("recorded_tags").alias("tags")), "id",
        "left")


def sort_by_normal_form(texts: Column) -> Column:
    """Texts ordered by their folded words, then as written."""
    keyed = F.transform(texts, lambda t: F.struct(normalize_words(t).alias("k"), t.alias("t")))
    return F.transform(F.sort_array(keyed), lambda p: p["t"])

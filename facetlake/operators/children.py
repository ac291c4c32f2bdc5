"""Child rows of records: selection, gathering, texts, links and files.

A parent may own any number of children, so child data stays in long form, one row per child.
Where several children go into one cell, the group is a chunk of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions.patterns import linked_item_ids
from facetlake.functions.text import RECORD_SEPARATOR, strip_markup
from facetlake.functions.values import json_value
from facetlake.operators.hierarchy import live
from facetlake.operators.tags import tag_gate

CHUNK = 1000


def children_of_type(
    items: DataFrame, item_type: str, include: str | Sequence[str] = "",
    exclude: str | Sequence[str] = "",
) -> DataFrame:
    """Live children of one type that pass the tag gate."""
    return items.filter(
        F.col("parent_item").isNotNull() & (F.col("item_type") == item_type)
        & live(F.col("trashed")) & tag_gate(F.col("tags"), include, exclude)
    )


def gather_chunks(
    rows: DataFrame, group: str, order: str, value: Column, name: str, size: int = CHUNK
) -> DataFrame:
    """Values of a group in order as arrays of at most ``size``: ``group, chunk, name``.

    ``order`` is a dense number within the group, so a chunk never outgrows its size and a
    huge group becomes many rows instead of one.
    """
    return (
        rows.withColumn("chunk", F.floor(F.col(order) / size).cast("bigint"))
        .groupBy(group, "chunk")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), value.alias("v"))))
             .alias("_pairs"))
        .select(group, "chunk", F.transform("_pairs", lambda p: p["v"]).alias(name))
    )


def concat_texts(
    rows: DataFrame, group: str, order: str, text: Column, size: int = CHUNK
) -> DataFrame:
    """A10: texts of a group in order, joined by the record separator, per chunk."""
    kept = rows.filter(text.isNotNull())
    return gather_chunks(kept, group, order, text, "_texts", size).select(
        group, "chunk", F.array_join("_texts", RECORD_SEPARATOR).alias("text")
    )


def children_by_parent(
    parents: DataFrame, children: DataFrame, key: str, order: str, value: Column,
    size: int = CHUNK,
) -> DataFrame:
    """Each parent with its children, gathered before the join so it never fans out."""
    return parents.join(gather_chunks(children, key, order, value, "children", size), key, "left")


def child_notes(notes: DataFrame) -> DataFrame:
    """M7: ``id, child_key, note, text``: raw note and its visible text."""
    note = json_value(F.col("data"), "note")
    return (
        notes.select(F.col("parent_item").alias("id"), F.col("item_key").alias("child_key"),
                     note.alias("note"))
        .filter("note <> ''")
        .withColumn("text", strip_markup(F.col("note")))
    )


def cited_in_notes(notes: DataFrame) -> DataFrame:
    """M7: ``id, ref``: ids of library items cited by the notes."""
    note = F.coalesce(json_value(F.col("data"), "note"), F.lit(""))
    return notes.select(
        F.col("parent_item").alias("id"), F.explode(linked_item_ids(note)).alias("ref")
    ).distinct()


def child_links(attachments: DataFrame) -> DataFrame:
    """M5: ``id, child_key, title, url`` of attached links."""
    data = F.col("data")
    return attachments.select(
        F.col("parent_item").alias("id"), F.col("item_key").alias("child_key"),
        F.coalesce(json_value(data, "title"), json_value(data, "url")).alias("title"),
        json_value(data, "url").alias("url"),
        json_value(data, "linkMode").alias("mode"),
    ).filter("mode = 'linked_url' AND url <> ''").drop("mode")


def _accepted(media_types: Sequence[str] | None) -> Column:
    return F.col("content_type").isin(*media_types) if media_types else F.lit(True)


def with_files_fulltext(attachments: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """Attachments with their file and full text, where they exist."""
    return attachments.join(files, "item_key", "left").join(
        texts.select("item_key", "content"), "item_key", "left"
    )


def child_files(
    attachments: DataFrame, files: DataFrame, media_types: Sequence[str] | None = None
) -> DataFrame:
    """M6: ``id, child_key, data, download_status`` of stored files."""
    return (
        attachments.select("item_key", "parent_item").join(files, "item_key")
        .filter(_accepted(media_types))
        .select(
            F.col("parent_item").alias("id"), F.col("item_key").alias("child_key"),
            F.struct("content_type", "charset", "filename", "md5", "mtime").alias("data"),
            "download_status",
        )
    )


def child_fulltext(
    attachments: DataFrame, files: DataFrame, texts: DataFrame,
    media_types: Sequence[str] | None = None,
) -> DataFrame:
    """``id, child_key, text``: visible text of stored, readable files."""
    both = with_files_fulltext(attachments, files, texts)
    return both.filter(
        F.col("content_type").isNotNull() & F.col("content").isNotNull() & _accepted(media_types)
    ).select(
        F.col("parent_item").alias("id"), F.col("item_key").alias("child_key"),
        strip_markup(F.col("content")).alias("text"),
    )

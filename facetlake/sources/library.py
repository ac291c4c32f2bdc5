"""The normalised library tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the library tables. JSON columns are text.
SCHEMAS = {
    "collection": "collection_key string, version int, name string, parent_collection string, "
                  "meta string, links string, data string, trashed boolean",
    "item_type": "item_type string",
    "item_type_locale": "item_type string, locale string, localized string",
    "item_type_field": "item_type string, field string, position int",
    "item_type_field_locale": "item_type string, field string, locale string, localized string",
    "item_type_creator_type": "item_type string, creator_type string, position int",
    "item_type_creator_type_locale": "item_type string, creator_type string, locale string, "
                                     "localized string",
    "item": "item_key string, version int, item_type string, parent_item string, meta string, "
            "links string, data string, relations string, trashed boolean",
    "deleted_collection": "collection_key string",
    "deleted_item": "item_key string",
    "sync_history": "history_id int, library_id string, library_prefix string, "
                    "since_version int, to_version int, started_on timestamp, "
                    "ended_on timestamp",
    "item_collection": "item_key string, collection_key string",
    "item_tag": "item_key string, tag string",
    "item_bib": "item_key string, style string, locale string, bib string",
    "item_export_format": "item_key string, format string, content string",
    "item_file": "item_key string, content_type string, charset string, filename string, "
                 "md5 string, mtime bigint, download_status string",
    "item_fulltext": "item_key string, content string, indexed_pages int, total_pages int, "
                     "indexed_chars int, total_chars int",
}

CREATOR = "struct<creatorType:string,firstName:string,lastName:string,name:string>"
DATA = (
    f"struct<creators:array<{CREATOR}>,tags:array<struct<tag:string>>,"
    "collections:array<string>>"
)
META = "struct<parsedDate:string>"
LINKS = "map<string,struct<href:string,type:string>>"


class LibraryEmptyError(ValueError):
    """The library was never synchronised."""


@dataclass
class Library:
    """One DataFrame per table."""

    collection: DataFrame
    item_type: DataFrame
    item_type_locale: DataFrame
    item_type_field: DataFrame
    item_type_field_locale: DataFrame
    item_type_creator_type: DataFrame
    item_type_creator_type_locale: DataFrame
    item: DataFrame
    deleted_collection: DataFrame
    deleted_item: DataFrame
    sync_history: DataFrame
    item_collection: DataFrame
    item_tag: DataFrame
    item_bib: DataFrame
    item_export_format: DataFrame
    item_file: DataFrame
    item_fulltext: DataFrame


def load_library(
    spark: SparkSession, path: str, source: str = "parquet", **options: str
) -> Library:
    """Open every table of a library with its fixed schema.

    ``parquet`` (also orc, json) reads a folder per table; ``jdbc`` reads the tables of a
    database given by ``path`` as URL.
    """
    def table(name: str) -> DataFrame:
        if source == "jdbc":
            read = spark.read.format("jdbc").options(url=path, dbtable=name, **options).load()
            wanted = [c.strip().split(" ")[0] for c in SCHEMAS[name].split(",")]
            return read.select(*wanted)
        return spark.read.format(source).schema(SCHEMAS[name]).options(**options).load(
            f"{path}/{name}"
        )

    return Library(**{f.name: table(f.name) for f in fields(Library)})


def decode_json(items: DataFrame) -> DataFrame:
    """Nested parts of the JSON columns as structs; open keys stay in the ``data`` text."""
    data = F.from_json("data", DATA)
    return items.withColumns({
        "creators": data["creators"],
        "tags": F.transform(data["tags"], lambda t: t["tag"]),
        "collections": data["collections"],
        "parsed_date": F.from_json("meta", META)["parsedDate"],
        "link_map": F.from_json("links", LINKS),
    })


def library_state(history: DataFrame) -> DataFrame:
    """S3: the latest synchronisation as one row (no row if there was none)."""
    latest = history.agg(
        F.max_by(F.struct("since_version", "to_version", "ended_on"), "history_id").alias("s")
    )
    return latest.filter("s IS NOT NULL").select("s.*")


def require_state(history: DataFrame):
    """S3: the state row on the driver, or an error for an empty library."""
    row = library_state(history).first()
    if row is None:
        raise LibraryEmptyError("the library has no synchronisation history")
    return row

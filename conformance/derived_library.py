"""A library derived from the order tables: orders are records, their lines are children,
customers write them, regions and nations are collections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conformance.inputs import table
from facetlake.functions.patterns import LIBRARY_HOST
from facetlake.session import lay_down
from facetlake.sources.library import Library

URI = f"http://{LIBRARY_HOST}/groups/1/items/"
TYPES = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'book' WHEN '2' THEN 'conferencePaper' " \
        "WHEN '3' THEN 'journalArticle' WHEN '4' THEN 'report' ELSE 'thesis' END"


def _rows(spark: SparkSession, columns: str, values: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def line_key(prefix: str = "") -> str:
    return f"concat('L', {prefix}l_orderkey, 'x', {prefix}l_linenumber, 'x', {prefix}l_partkey, " \
           f"'x', {prefix}l_suppkey)"


def derived_library(spark: SparkSession, d: str) -> Library:
    lines, records = table(spark, d, "lineitem"), _records(spark, d)
    children = _children(lines.repartition("l_orderkey", "l_linenumber"))
    types = ("book", "conferencePaper", "journalArticle", "report", "thesis")
    fields = ["title", "abstractNote", "date", "DOI", "extra"]
    first = {"thesis": "subject"}
    listed = [(t, first.get(t, f) if i == 0 else f, i + 1)
              for t in types for i, f in enumerate(fields)]
    type_field = _rows(spark, "item_type, field, position",
                       ", ".join(f"('{t}', '{f}', {n})" for t, f, n in listed))
    creators = [(t, c, n + 1) for t in types for n, c in enumerate(("author", "editor"))]
    type_creator = _rows(spark, "item_type, creator_type, position",
                         ", ".join(f"('{t}', '{c}', {n})" for t, c, n in creators))
    kept = lines.filter("l_returnflag = 'A'")
    events = table(spark, d, "events")
    return Library(
        collection=_collections(spark, d),
        item_type=_rows(spark, "item_type", ", ".join(f"('{t}')" for t in types)),
        item_type_locale=_rows(spark, "item_type, locale, localized", ", ".join(
            f"('{t}', 'en-US', '{t.title()} label')" for t in types if t != "report")),
        item_type_field=type_field,
        item_type_field_locale=type_field.select(
            "item_type", "field", F.lit("en-US").alias("locale"),
            F.initcap("field").alias("localized")),
        item_type_creator_type=type_creator,
        item_type_creator_type_locale=type_creator.select(
            "item_type", "creator_type", F.lit("en-US").alias("locale"),
            F.initcap("creator_type").alias("localized")),
        item=records.unionByName(children),
        deleted_collection=table(spark, d, "nation").filter("n_name = 'NATION_7'").select(
            F.expr("concat('N', n_nationkey)").alias("collection_key")),
        deleted_item=_deleted(spark, d),
        sync_history=events.select(
            F.col("event_id").cast("int").alias("history_id"), F.lit("1").alias("library_id"),
            F.lit("groups").alias("library_prefix"), F.lit(0).alias("since_version"),
            F.col("user_id").cast("int").alias("to_version"), F.col("ts").alias("started_on"),
            F.col("ts").alias("ended_on")),
        item_collection=records.select(
            "item_key", F.explode(F.from_json("data", "collections array<string>")["collections"])
            .alias("collection_key")),
        item_tag=records.select(
            "item_key", F.explode(F.from_json("data", "tags array<struct<tag:string>>")["tags"])
            .alias("t")).select("item_key", F.col("t.tag").alias("tag")),
        item_bib=table(spark, d, "orders").select(
            F.expr("concat('O', o_orderkey)").alias("item_key"), F.lit("apa").alias("style"),
            F.lit("en-US").alias("locale"),
            F.expr("concat('<div>Order ', o_orderkey, '</div>')").alias("bib")),
        item_export_format=table(spark, d, "orders").select(
            F.expr("concat('O', o_orderkey)").alias("item_key"),
            F.explode(F.array(*[F.lit(n) for n in ("coins", "ris", "bibtex")])).alias("format"),
            "o_orderkey",
        ).select("item_key", "format",
                 F.expr("concat(format, ' of ', o_orderkey)").alias("content")),
        item_file=kept.select(
            F.expr(line_key()).alias("item_key"),
            F.expr("CASE l_linestatus WHEN 'F' THEN 'application/pdf' ELSE 'text/html' END")
            .alias("content_type"), F.lit("utf-8").alias("charset"),
            F.expr("concat('part', l_partkey, '.pdf')").alias("filename"),
            F.lit(None).cast("string").alias("md5"), F.lit(None).cast("bigint").alias("mtime"),
            F.lit("ok").alias("download_status")),
        item_fulltext=kept.select(
            F.expr(line_key()).alias("item_key"),
            F.expr("concat('<p>Full text of part ', l_partkey, '</p>')").alias("content"),
            *[F.lit(None).cast("int").alias(c) for c in
              ("indexed_pages", "total_pages", "indexed_chars", "total_chars")]),
    )


def _deleted(spark: SparkSession, d: str) -> DataFrame:
    """Orders of customers in debt count as deleted."""
    poor = table(spark, d, "customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(poor, "o_custkey", "left_semi").select(
        F.expr("concat('O', o_orderkey)").alias("item_key"))


def _collections(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "region").select(
        F.expr("concat('R', r_regionkey)").alias("collection_key"),
        F.col("r_regionkey").alias("version"), F.col("r_name").alias("name"),
        F.lit(None).cast("string").alias("parent_collection"),
        (F.col("r_name") == "MIDDLE EAST").alias("trashed"))
    nations = table(spark, d, "nation").select(
        F.expr("concat('N', n_nationkey)").alias("collection_key"),
        F.col("n_nationkey").alias("version"), F.col("n_name").alias("name"),
        F.expr("concat('R', n_regionkey)").alias("parent_collection"),
        F.lit(None).cast("boolean").alias("trashed"))
    return regions.unionByName(nations).select(
        "collection_key", "version", "name", "parent_collection",
        F.lit("{}").alias("meta"), F.lit("{}").alias("links"), F.lit("{}").alias("data"),
        "trashed")


def _records(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    # The given tables are single files: rows are spread before the costly JSON work.
    spread = table(spark, d, "orders").repartition("o_orderkey")
    orders = spread.join(customers, F.col("o_custkey") == F.col("c_custkey")).withColumns({
        "item_type": F.expr(TYPES),
        "day": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "stamp": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    })
    data = F.to_json(F.expr("""named_struct(
        'itemType', item_type,
        'title', concat('<i>Order</i> ', o_orderkey, ' of ', c_name),
        'subject', concat('Thesis ', o_orderkey),
        'creators', array(
            named_struct('creatorType', 'author', 'firstName', c_mktsegment, 'lastName', c_name,
                         'name', CAST(NULL AS STRING)),
            named_struct('creatorType', 'editor', 'firstName', CAST(NULL AS STRING),
                         'lastName', CAST(NULL AS STRING),
                         'name', concat('Nation ', c_nationkey))),
        'abstractNote', concat('Priority ', o_orderpriority, ' & status ', o_orderstatus),
        'date', day,
        'language', CASE o_orderstatus WHEN 'F' THEN 'en; fre' WHEN 'O' THEN 'German' ELSE '' END,
        'url', CASE o_orderstatus WHEN 'F' THEN concat('https://shop.example.org/o/', o_orderkey)
               ELSE '' END,
        'extra', CASE o_orderstatus WHEN 'O' THEN concat('DOI: 10.5555/', o_orderkey, '\\nNote: x')
                 ELSE '' END,
        'DOI', CASE o_orderstatus WHEN 'F' THEN concat('10.1234/', o_orderkey) END,
        'ISBN', CASE item_type WHEN 'book' THEN concat('978-', o_orderkey) END,
        'publisher', c_mktsegment,
        'pages', concat(o_orderkey, '-', o_orderkey + 9),
        'volume', CAST(c_nationkey AS STRING),
        'publicationTitle', CASE item_type WHEN 'journalArticle' THEN 'Order Letters' END,
        'university', CASE item_type WHEN 'thesis' THEN concat('University of ', c_nationkey) END,
        'tags', filter(array(
            named_struct('tag', c_mktsegment), named_struct('tag', concat(' Status ', o_orderstatus)),
            CASE WHEN o_totalprice > 100000 THEN named_struct('tag', '_large') END),
            t -> t IS NOT NULL),
        'collections', array(concat('N', c_nationkey)),
        'dateAdded', stamp, 'dateModified', stamp)"""))
    return orders.select(
        F.expr("concat('O', o_orderkey)").alias("item_key"),
        F.col("o_orderkey").cast("int").alias("version"), "item_type",
        F.lit(None).cast("string").alias("parent_item"),
        F.to_json(F.struct(F.expr("""CASE o_orderstatus WHEN 'F' THEN day
            WHEN 'O' THEN substr(day, 1, 7) ELSE substr(day, 1, 4) END""").alias("parsedDate")))
        .alias("meta"),
        F.expr("""concat('{"alternate":{"href":"https://library.example.org/', o_orderkey,
            '","type":"text/html"}}')""").alias("links"),
        data.alias("data"),
        F.expr(f"""concat('{{"dc:relation":["{URI}O', o_custkey, '"],"dc:replaces":"{URI}X',
            o_orderkey, '"}}')""").alias("relations"),
        F.expr("CASE WHEN o_totalprice < 20000 THEN true END").alias("trashed"))


def _children(lines: DataFrame) -> DataFrame:
    note = F.expr(f"""to_json(named_struct('note', concat('<p>Line <b>', l_linenumber,
        '</b> ships &amp; cites <a href="{URI}O', l_suppkey, '">it</a><br/>see {URI}O',
        l_suppkey + 1, '</p>'), 'tags',
        CASE l_linestatus WHEN 'F' THEN array(named_struct('tag', '_cites'))
        ELSE CAST(array() AS array<struct<tag:string>>) END))""")
    attached = F.expr("""to_json(named_struct(
        'linkMode', CASE l_returnflag WHEN 'R' THEN 'linked_url' ELSE 'imported_file' END,
        'title', CASE l_linestatus WHEN 'F' THEN concat('Part ', l_partkey) END,
        'url', concat('https://parts.example.org/', l_partkey)))""")
    return lines.select(
        F.expr(line_key()).alias("item_key"), F.col("l_orderkey").cast("int").alias("version"),
        F.expr("CASE l_returnflag WHEN 'N' THEN 'note' ELSE 'attachment' END").alias("item_type"),
        F.expr("concat('O', l_orderkey)").alias("parent_item"),
        F.lit("{}").alias("meta"), F.lit("{}").alias("links"),
        F.when(F.col("l_returnflag") == "N", note).otherwise(attached).alias("data"),
        F.lit(None).cast("string").alias("relations"),
        F.expr("CASE WHEN l_quantity >= 45 THEN true END").alias("trashed"))


# The derived library as it was synchronised three times: records of the last month are still
# missing at first, those of the month before are drafts, and the oldest are deleted in the end.
FIRST_STATE, LAST_STATE = 0, 2
ERAS = """CASE WHEN o_orderdate < TIMESTAMP '1995-02-01' THEN 'gone'
          WHEN o_orderdate >= TIMESTAMP '2001-07-01' THEN 'new'
          WHEN o_orderdate >= TIMESTAMP '2001-06-01' THEN 'changed' END"""


def library_states(spark: SparkSession, d: str) -> Callable[[int], Library]:
    """The derived library after each synchronisation (0 to 2). Its costly tables, which the
    states share, are laid down once: a library is stored tables."""
    whole = derived_library(spark, d)
    eras = table(spark, d, "orders").select(
        F.expr("concat('O', o_orderkey)").alias("owner"), F.expr(ERAS).alias("era"))
    rows = lay_down(whole.item.withColumn("owner", F.coalesce("parent_item", "item_key")).join(
        eras, "owner", "left").withColumn("era", F.coalesce("era", F.lit(""))).drop("owner"))
    shared = replace(
        whole, item_collection=lay_down(whole.item_collection), item_tag=lay_down(whole.item_tag),
        deleted_collection=whole.deleted_collection.limit(0),
        collection=whole.collection.withColumn("version", F.lit(1)))

    def at(state: int) -> Library:
        present = F.expr(f"era <> 'new' OR {state} = 2") & F.expr(f"era <> 'gone' OR {state} < 2")
        version = F.expr(f"CASE WHEN era = 'changed' AND {state} > 0 AND parent_item IS NULL "
                         "THEN 2 WHEN era = 'new' THEN 3 ELSE 1 END")
        draft = F.replace("data", F.lit("<i>Order</i>"), F.lit("Draft"))
        data = F.when((F.col("era") == "changed") & F.lit(state == 0), draft).otherwise(
            F.col("data"))
        items = rows.where(present).withColumns({"version": version, "data": data})
        history = spark.createDataFrame(
            [(n + 1, "1", "groups", n, n + 1, datetime(2002, 1, n + 1), datetime(2002, 1, n + 1, 1))
             for n in range(state + 1)],
            "history_id int, library_id string, library_prefix string, since_version int, "
            "to_version int, started_on timestamp, ended_on timestamp")
        gone = eras.where(f"era = 'gone' AND {state} = 2").select(F.col("owner").alias("item_key"))
        return replace(shared, item=items.select(*whole.item.columns), sync_history=history,
                       deleted_item=gone)

    return at


def library_at(spark: SparkSession, d: str, state: int) -> Library:
    """The derived library after synchronisation ``state`` (0 to 2)."""
    return library_states(spark, d)(state)


RECORDS_SQL = f"""
rec AS (
  SELECT 'O' || o_orderkey AS id, o.*, c.c_name, c.c_mktsegment, c.c_nationkey,
         {TYPES} AS item_type, strftime(o_orderdate, '%Y-%m-%d') AS day,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp,
         CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
              WHEN 'O' THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y')
         END AS parsed_date
  FROM orders o JOIN customer c ON o_custkey = c_custkey WHERE o_totalprice >= 20000),
kids AS (
  SELECT 'O' || l_orderkey AS id, 'L' || l_orderkey || 'x' || l_linenumber || 'x' || l_partkey
         || 'x' || l_suppkey AS child_key, l.*
  FROM lineitem l WHERE l_quantity < 45 AND 'O' || l_orderkey IN (SELECT id FROM rec))
"""

"""The given tables in the roles the operators expect."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.operators.index_tables import (
    TermIndex, build_term_index, index_of_words, word_rows,
)
from facetlake.plans.catalog import Catalog, FacetSpec, IndexField, SortSpec
from facetlake.session import scratch_dir
from facetlake.sources.store import write_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- documents as searchable records ----------------------------------------------------

FIELDS = (
    IndexField("text", "name", 1.0, ("all", "fulltext")),
    IndexField("source", "id", 4.0, ("all", "metadata")),
    IndexField("lang", "id", 2.0, ("all", "metadata", "language")),
)
FACETS = (
    FacetSpec("lang", "lang", "lang", "flat", initial_limit=2, initial_leeway=1),
    FacetSpec("source", "source", "source", "flat", initial_limit=10, initial_leeway=4,
              sort_by=("count", "label")),
    FacetSpec("tag", "tags", "topic", "flat", multi=True, missing_label="Unlabelled"),
)
SORTS = (
    SortSpec("score", ()),
    SortSpec("longest", ("n_chars",), True),
    SortSpec("mixed", ("lang", "n_chars"), (False, True)),
)
CATALOG = Catalog(fields=FIELDS, facets=FACETS, sorts=SORTS)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``id, item_type, lang, source, n_chars, text, tags``; tags come from the labels."""
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"),
        F.array_compact(F.array(
            F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")
        )).alias("tags"),
    )
    docs = table(spark, folder, "documents").withColumnRenamed("doc_id", "id")
    return docs.join(labels, "id", "left").select(
        "id", F.lit("document").alias("item_type"), "lang", "source", "n_chars", "text", "tags"
    )


def document_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Long searchable texts of the documents."""
    docs = table(spark, folder, "documents")
    entries = [
        F.struct(F.lit(f.name).alias("field"), F.lit("").alias("part"),
                 F.col(f.name).alias("text"))
        for f in FIELDS
    ]
    return docs.select(F.col("doc_id").alias("id"), F.explode(F.array(*entries)).alias("e")).select(
        "id", "e.*"
    )


def fresh_index(spark: SparkSession, folder: str) -> TermIndex:
    """Term tables of the documents, computed now."""
    ids = table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    return build_term_index(ids, document_texts(spark, folder), FIELDS)


_BUILT: dict[tuple[str, ...], str] = {}
_STATS = ("term_stats", "field_stats")


def kept_index(
    spark: SparkSession, folder: str, name: str, texts: Callable[[SparkSession, str], DataFrame],
    fields: Sequence[IndexField],
) -> TermIndex:
    """Term tables of some ``texts`` of the documents, written to the shared scratch folder once
    per application.

    This is how searches use them: built by one job, then only read. Words are written once,
    sorted where they are; postings and positions are columns of that table.
    """
    ids = table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _BUILT:
        digest = hashlib.sha256("/".join(key).encode()).hexdigest()[:16]
        root = f"{scratch_dir(spark)}/{name}-{digest}"
        write_table(word_rows(texts(spark, folder), fields), "positions", f"{root}/words")
        index = index_of_words(ids, spark.read.parquet(f"{root}/words"))
        for stats in _STATS:
            write_table(getattr(index, stats), stats, f"{root}/{stats}")
        _BUILT[key] = root
    root = _BUILT[key]
    index = index_of_words(ids, spark.read.parquet(f"{root}/words"))
    return replace(index, **{n: spark.read.parquet(f"{root}/{n}") for n in _STATS})


def stored_index(spark: SparkSession, folder: str) -> TermIndex:
    """Term tables of the documents as searches use them, see ``kept_index``."""
    return kept_index(spark, folder, "term-index", document_texts, FIELDS)


# --- orders as dated records ------------------------------------------------------------


def dated(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a partial date text: day, month or year precision by status."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority", "o_totalprice",
        "o_orderdate", "o_custkey",
        F.when(F.col("o_orderstatus") == "F", day)
        .when(F.col("o_orderstatus") == "O", F.substring(day, 1, 7))
        .otherwise(F.substring(day, 1, 4)).alias("parsed_date"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("added"),
    )


DATED_SQL = """
dated AS (
  SELECT o_orderkey AS id, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate, o_custkey,
         CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
                            WHEN 'O' THEN strftime(o_orderdate, '%Y-%m')
                            ELSE strftime(o_orderdate, '%Y') END AS parsed_date,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS added
  FROM orders)
"""

# --- geography as a tree ----------------------------------------------------------------


def geography(spark: SparkSession, folder: str) -> DataFrame:
    """``key, parent, name, trashed``: regions, nations and customers. Indebted customers and
    one region count as trashed."""
    regions = table(spark, folder, "region").select(
        F.concat(F.lit("R"), "r_regionkey").alias("key"), F.lit(None).cast("string")
        .alias("parent"), F.col("r_name").alias("name"),
        (F.col("r_name") == "MIDDLE EAST").alias("trashed"),
    )
    nations = table(spark, folder, "nation").select(
        F.concat(F.lit("N"), "n_nationkey").alias("key"),
        F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"),
        F.lit(None).cast("boolean").alias("trashed"),
    )
    customers = table(spark, folder, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("key"),
        F.concat(F.lit("N"), "c_nationkey").alias("parent"), F.col("c_name").alias("name"),
        (F.col("c_acctbal") < 0).alias("trashed"),
    )
    return regions.unionByName(nations).unionByName(customers)


GEOGRAPHY_SQL = """
nodes AS (
  SELECT 'R' || r_regionkey AS key, NULL AS parent, r_name AS name,
         r_name = 'MIDDLE EAST' AS trashed FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, NULL FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, c_name, c_acctbal < 0 FROM customer),
closure AS (
  SELECT 'R' || r_regionkey AS key, ['R' || r_regionkey] AS path FROM region
  WHERE r_name <> 'MIDDLE EAST'
  UNION ALL SELECT 'N' || n_nationkey, ['R' || n_regionkey, 'N' || n_nationkey]
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'MIDDLE EAST'
  UNION ALL SELECT 'C' || c_custkey, ['R' || n_regionkey, 'N' || n_nationkey, 'C' || c_custkey]
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_name <> 'MIDDLE EAST' AND c_acctbal >= 0)
"""

# --- shared SQL fragments ---------------------------------------------------------------


def sql_fold(expr: str) -> str:
    return f"replace(strip_accents(lower({expr})), 'ß', 's')"


TOKEN_RE = r"[\p{L}\p{N}_]+(?:\.?[\p{L}\p{N}_]+)*"


def sql_tokens(expr: str) -> str:
    return rf"regexp_extract_all({expr}, '{TOKEN_RE}|\x1e')"


def sql_words(expr: str) -> str:
    """Folded words joined by a blank."""
    return f"array_to_string(regexp_extract_all({sql_fold(expr)}, '{TOKEN_RE}'), ' ')"


DOCS_SQL = """
docs AS (
  SELECT d.doc_id AS id, d.text, d.lang, d.source, d.n_chars,
         CASE WHEN l.doc_id IS NULL THEN NULL
              ELSE list_filter([CASE WHEN quality = 1 THEN 'quality' END,
                                CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)
         END AS tags
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""

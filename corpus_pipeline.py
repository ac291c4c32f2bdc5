"""From raw documents to packed token sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.llm.lines import dedup_lines
from facetlake.llm.near_duplicates import keep_one_of_each
from facetlake.llm.packing import pack_documents
from facetlake.llm.privacy import mask_documents
from facetlake.llm.quality import keep_good_documents
from facetlake.llm.queries import LlmCase, table
from facetlake.llm.scratch import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _recounted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that only had such lines goes."""
    rest = dedup_lines(docs)
    has_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _recounted(rest.where((F.col("lines_dropped") == 0) | has_words).select(*docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one_of_each(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return _recounted(mask_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("lines", lines), ("near_copies", near_copies), ("privacy", privacy),
    ("packing", packing),
]
# Estimates, components over hashes and tokens are beyond SQL; tests/llm holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE_CASES = {"pipeline": LlmCase(run, ORACLE_SQL)}

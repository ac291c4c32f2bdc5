"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.llm import sql
from facetlake.llm.alignment import align_tokenizers
from facetlake.llm.contamination import judge_contamination
from facetlake.llm.merkle import build_manifest, leaf_digest, prove, verify
from facetlake.llm.quality import judge_quality
from facetlake.llm.privacy import span_digest, span_table
from facetlake.llm.bpe import decode_documents, encode_documents
from facetlake.llm.packing import pack_documents
from facetlake.llm.near_duplicates import near_duplicates
from facetlake.llm.repeats import remove_repeats
from facetlake.llm.neighbours import nearest_vectors
from facetlake.llm.lines import dedup_lines
from facetlake.llm.sharding import shard_rows
from facetlake.llm.urls import Rule, canonical_url, judge_urls


@dataclass(frozen=True)
class LlmCase:
    query: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


URL_RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
# Pages with one of these words put their canonical URL on the list.
LISTING_WORDS = ("stupid", "trash", "worthless", "disgusting", "scum")


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL, judged by the rules and the list of the URLs of abusive pages."""
    pages = table(spark, folder, "pages")
    listed = pages.where(F.col("html").rlike(sql.LISTING_RE)).select(
        canonical_url(F.col("url")).alias("entry"))
    return judge_urls(pages, listed, URL_RULES)


def op7_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard among 8, its place there and its shard among 9."""
    return shard_rows(table(spark, folder, "documents"), 8)


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's counts and verdict."""
    return judge_quality(table(spark, folder, "documents"))


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's spans of personal data."""
    return span_digest(span_table(table(spark, folder, "documents")))


def op1_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = encode_documents(table(spark, folder, "documents"), path, pattern)
    decoded = decode_documents(encoded, path, pattern)
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens, packed into sequences of at most 4096."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(table(spark, folder, "documents"), path)


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's component of near copies."""
    return near_duplicates(table(spark, folder, "documents"))


def op5_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the bytes of repeated passages, as a digest."""
    return remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    vectors = table(spark, folder, "embeddings")
    return nearest_vectors(vectors, F.col("vec_id") % 100 == 0)


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text without repeated lines, as a digest."""
    return dedup_lines(table(spark, folder, "documents")).select(
        "doc_id", "lines_before", "lines_dropped",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, proof and check, with half of the texts tampered with."""
    docs = table(spark, folder, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    even = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    joined = F.when(even, F.translate(docs["text"], "\n", "")).otherwise(docs["text"])
    claim = leaf_digest([*[docs[c] for c in columns[:-1]], joined])
    manifest = build_manifest(docs, columns, carried={"claim": claim})
    checked = verify(prove(manifest), "claim")
    root = F.lit(manifest.root.hex() if manifest.root else None).cast("string")
    names = {"leaf": "leaf", "subroot": "subroot", "proof_sha256": "siblings",
             "folded_root": "folded"}
    texts = {new: F.lower(F.hex(old)) for new, old in names.items()}
    return checked.select(
        F.col("key").alias("doc_id"), *[c.alias(n) for n, c in texts.items()],
        root.alias("root"), (texts["folded_root"] == root).alias("verified"))


def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's groups and links between the tokens of two tokenizers."""
    return align_tokenizers(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's words inside passages of benchmark items."""
    judged = judge_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated")


LLM_CASES: dict[str, LlmCase] = {
    "op6_line_dedup": LlmCase(op6_line_dedup),
    "op9_nearest_neighbours": LlmCase(op9_nearest_neighbours),
    "op5_repeated_passages": LlmCase(op5_repeated_passages),
    "op4_near_duplicates": LlmCase(op4_near_duplicates, sql.NEAR_DUPLICATES),
    "op3_best_fit_packing": LlmCase(op3_best_fit_packing),
    "op1_byte_pairs": LlmCase(op1_byte_pairs),
    "op8_personal_data": LlmCase(op8_personal_data),
    "op2_url_filter": LlmCase(op2_url_filter, sql.URL_FILTER),
    "op7_jump_shards": LlmCase(op7_jump_shards, sql.jump_shards(8)),
    "op10_quality_rules": LlmCase(op10_quality_rules),
    "op11_merkle_manifest": LlmCase(op11_merkle_manifest, sql.MERKLE_MANIFEST),
    "op12_tokenizer_alignment": LlmCase(op12_tokenizer_alignment),
    "op13_decontamination": LlmCase(op13_decontamination, sql.CONTAMINATION),
}

"""Shards by jump consistent hashing, with DataFrame functions only.

A key's path is a chain of jumps that depends on the key alone; its shard is the last landing
place below the shard count. With one shard more, a key either stays or jumps to the new shard.
No ring table is kept, and nothing is shuffled to find a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.operators.numbering import global_positions

_LOW32 = 0xFFFFFFFF
# Fixed value of the published algorithm: the multiplier of its generator.
MULTIPLIER = 2862933555777941757
_MUL_HIGH, _MUL_LOW = MULTIPLIER >> 32, MULTIPLIER & _LOW32
# Jumps done for every row. More are needed once in 10^20 rows; those rows go on to the end.
USUAL_JUMPS = 64


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """``key * MULTIPLIER + 1`` modulo 2^64 on 32-bit halves, free of overflow in ANSI mode."""
    part0 = (low.bitwiseAND(0xFFFF)) * _MUL_LOW + 1
    part1 = F.shiftright(low, 16) * _MUL_LOW + F.shiftright(part0, 16)
    new_low = F.shiftleft(part1.bitwiseAND(0xFFFF), 16).bitwiseOR(part0.bitwiseAND(0xFFFF))
    mixed = (
        F.shiftright(part1, 16)
        + (low * _MUL_HIGH).bitwiseAND(_LOW32)
        + high.bitwiseAND(0xFFFF) * _MUL_LOW
        + F.shiftleft((F.shiftright(high, 16) * _MUL_LOW).bitwiseAND(0xFFFF), 16)
    )
    return mixed.bitwiseAND(_LOW32), new_low


def jump_hash(key: Column, n_shards: int) -> Column:
    """The shard (0 to ``n_shards - 1``) of a long key; a null key counts as 0."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("jump"),
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(_LOW32).alias("low"),
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _next_state(state["high"], state["low"])
        landing = F.floor(
            (state["jump"] + 1).cast("double")
            * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))
        )
        return F.when(
            state["jump"] < n_shards,
            F.struct(state["jump"].alias("at"), landing.alias("jump"), high.alias("high"),
                     low.alias("low")),
        ).otherwise(state)

    usual = F.aggregate(F.sequence(F.lit(1), F.lit(min(n_shards, USUAL_JUMPS))), start, step)
    if n_shards > USUAL_JUMPS:
        rest = F.aggregate(F.sequence(F.lit(USUAL_JUMPS), F.lit(n_shards)), usual, step)
        usual = F.when(usual["jump"] < n_shards, rest).otherwise(usual)
    return usual["at"].cast("int")


def stable_key(column: Column, kind: str) -> Column:
    """Whole numbers stand for themselves, any other key for its 64-bit hash."""
    return column.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else (
        F.when(column.isNotNull(), F.xxhash64(column)))


def shard_rows(
    docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``slot`` numbers the rows of a shard from 0, by key. Rows are sorted by range over (shard,
    key, checksum), so a shard spans as many tasks as its rows need; no window runs over a shard.

    Defined cases: a null text has size 1 and checksum 0; a null key goes to the shard of key 0;
    repeated keys share their shard and get slots of their own; an empty table gives no rows.
    Only ``key`` and ``text`` are read, so further columns of any name are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    number = stable_key(docs[key], kind)
    body = F.coalesce(docs[text], F.lit(""))
    placed = docs.select(
        docs[key].alias("k"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        jump_hash(number, n_shards).alias("shard"),
        jump_hash(number, n_shards + 1).alias("grown_shard"),
    )
    order = [F.col("shard"), F.col("k"), F.col("text_crc32"), F.col("size")]
    numbered = global_positions(placed, order, "place")
    # One row per shard: bounded by the shard count, a parameter.
    starts = numbered.groupBy("shard").agg(F.min("place").alias("first"))
    return numbered.join(F.broadcast(starts), "shard").select(
        F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), "grown_shard",
    )


def write_shards(
    docs: DataFrame, path: str, n_shards: int, key: str = "doc_id", rows_per_file: int = 1_000_000
) -> None:
    """Write all rows and columns of ``docs`` as one folder of files per shard.

    Rows are dealt by shard and a salt drawn from the key, so that a shard of any size is
    written by several tasks.
    """
    kind = docs.schema[key].dataType.simpleString()
    shard = jump_hash(stable_key(docs[key], kind), n_shards)
    name = "shard" if "shard" not in docs.columns else "jump_shard"
    (
        docs.withColumn(name, shard)
        .repartition(F.col(name), F.pmod(F.xxhash64(F.col(key)), F.lit(8)))
        .write.option("maxRecordsPerFile", rows_per_file).partitionBy(name).parquet(path)
    )

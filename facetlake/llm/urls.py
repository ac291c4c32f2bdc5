"""Verdicts on URLs: host and path rules, then a list of canonical URLs, natively.

The list is tested by a blocked Bloom filter first: one 256-bit block per key, eight bits in it.
Only possible hits travel to the exact hash join with the list, which removes the false ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.llm.scratch import stored

WORDS, BITS_PER_WORD = 4, 64
BITS_PER_KEY = 16
# A filter never grows beyond this: 4 MiB of bits. A longer list fills it more densely, so that
# more URLs reach the exact join; the verdicts stay the same.
MAX_BLOCKS = 1 << 17


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(rest, upper, lower), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host, path without closing slashes, and the sorted parameters that don't track.

    Scheme, fragment and ``utm_`` parameters are dropped. Without ``://`` it is empty.
    """
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.sort_array(F.filter(
        F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")
    ))
    return F.concat(
        url_host(url), F.regexp_replace(url_path(url), "/+$", ""),
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
    )


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``text, verdict`` of the rule with the longest host, then the longest path, that fits
    the host or a parent domain and a prefix of the path; null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host), len(r.path), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(
            fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        ).otherwise(found)
    return found


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    """For each word of a block the two bits of a key, from 48 bits of a second hash."""
    bits = F.xxhash64(key, F.lit(1))

    def bit(i: int) -> Column:
        field = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(BITS_PER_WORD - 1).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), field)

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def bloom_filter(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """``block, w0 ... w3``: the filter as a table of at most ``n_blocks`` rows."""
    masked = keys.select(
        _block(F.col(key), n_blocks).alias("block"),
        *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col(key)))],
    )
    return masked.groupBy("block").agg(
        *[F.expr(f"bit_or(m{i})").alias(f"w{i}") for i in range(WORDS)]
    )


def possible_hits(rows: DataFrame, key: str, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """``rows`` with a flag ``possible``: false means that ``key`` is not listed."""
    # At most MAX_BLOCKS rows of five numbers, whatever the length of the list.
    found = rows.withColumn("block", _block(F.col(key), n_blocks)).join(
        F.broadcast(bloom), "block", "left")
    inside = F.lit(True)
    for i, mask in enumerate(_masks(F.col(key))):
        inside = inside & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    return found.select(*rows.columns, F.coalesce(inside, F.lit(False)).alias("possible"))


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule],
    id_column: str = "page_id",
    url_column: str = "url",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """``id, host, path, rule, verdict, canonical, listed`` of every row of ``pages``.

    A fitting rule decides; without one, a canonical URL in ``listed`` (one string column,
    repeats allowed) is blocked and any other allowed. A hot URL is split by adaptive execution
    in the join, whose other side holds each listed URL once.

    Defined cases: a null URL or one without ``://`` has empty host and path and is allowed;
    empty strings in the list are ignored; an empty list blocks nothing; repeated rows are each
    judged. Only the two named columns are read.
    """
    name = listed.columns[0]
    urls = stored(
        listed.select(F.col(name).alias("entry")).where("entry <> ''").distinct(), "listed-urls")
    n_blocks = max(1, min(max_blocks, -(-urls.count() * BITS_PER_KEY // (WORDS * BITS_PER_WORD))))
    bloom = bloom_filter(urls, "entry", n_blocks)

    rows = pages.select(
        pages[id_column].alias("id"), url_host(pages[url_column]).alias("host"),
        url_path(pages[url_column]).alias("path"), canonical_url(pages[url_column]).alias("key"),
    )
    tested = possible_hits(rows, "key", bloom, n_blocks)
    sure = tested.where(~F.col("possible")).withColumn("listed", F.lit(False))
    checked = tested.where("possible").join(
        urls.hint("shuffle_hash"), F.col("key") == F.col("entry"), "left"
    ).withColumn("listed", F.col("entry").isNotNull()).drop("entry")
    judged = sure.unionByName(checked).withColumn(
        "match", matching_rule(F.col("host"), F.col("path"), rules))
    return judged.select(
        F.col("id").alias(id_column), "host", "path", F.col("match.rule").alias("rule"),
        F.coalesce(F.col("match.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
        .alias("verdict"),
        F.col("key").alias("canonical"), "listed",
    )

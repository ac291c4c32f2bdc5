"""URLs, shards, personal data and quality against plain versions and SQL."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conformance.check import compare, connect
from facetlake.llm import privacy, quality
from facetlake.llm.queries import LLM_CASES, URL_RULES
from facetlake.llm.sharding import jump_hash, shard_rows, write_shards
from facetlake.llm.urls import bloom_filter, canonical_url, judge_urls, possible_hits
from tests.llm import plain
from tests.llm.conftest import FOLDER


@pytest.mark.parametrize("name", [n for n, c in LLM_CASES.items() if c.sql])
def test_queries_equal_their_sql(spark, name, monkeypatch):
    import conformance.check as check
    monkeypatch.setattr(check, "CASES", LLM_CASES)
    assert compare(spark, connect(FOLDER), FOLDER, name) == ""


# --- URLs -------------------------------------------------------------------------------

URLS = ["http://www.Example.com/en/a", "https://example.com/en/", "http://EXAMPLE.com", None, "",
        "no scheme", "ftp://x.net/fr/y#z", "http://x.net/de/p/?utm_a=1&b=2&a=1#f", "://?", "a://b",
        "http://x.net/de/p?a=1&b=2", "http://badexample.com/en/", "http://x.net/de/p/#q"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = spark.createDataFrame(list(enumerate(URLS)) + [(4, "a://b")],
                                 "page_id long, url string")
    return rows.select("*", *[F.lit("x").alias(c) for c in ("host", "path", "key", "block")])


@pytest.mark.parametrize("blocks", [1, 1 << 17])
def test_verdicts(spark, pages, blocks):
    listed = spark.createDataFrame([("x.net/de/p?a=1&b=2",), ("b",), ("",), (None,), ("b",)],
                                   "entry string")
    rows = judge_urls(pages, listed, URL_RULES, max_blocks=blocks).collect()
    assert len(rows) == pages.count()
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows
             if r["page_id"] != 4}
    assert found == {
        0: ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        1: ("example.com", "/en/", "example.com/en/", "block"),
        2: ("example.com", "", None, "allow"), 3: ("", "", None, "allow"),
        5: ("", "", None, "allow"), 6: ("x.net", "/fr/y", "net/fr/", "block"),
        7: ("x.net", "/de/p/", None, "block"), 8: ("", "", None, "allow"),
        9: ("b", "", None, "block"), 10: ("x.net", "/de/p", None, "block"),
        11: ("badexample.com", "/en/", "com/", "allow"), 12: ("x.net", "/de/p/", None, "allow"),
    }


def test_empty_list_and_empty_pages(spark, pages):
    none = spark.createDataFrame([], "entry string")
    assert judge_urls(pages, none, ()).where("verdict = 'block'").count() == 0
    assert judge_urls(pages.limit(0), none, URL_RULES).count() == 0


def test_filter_has_no_false_negatives_and_few_false_hits(spark):
    keys = spark.range(0, 4000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = bloom_filter(keys.limit(2000), "key", 125)
    tested = possible_hits(keys, "key", bloom, 125)
    inside = {r["key"] for r in keys.limit(2000).collect()}
    rows = tested.collect()
    assert all(r["possible"] for r in rows if r["key"] in inside)
    assert sum(r["possible"] for r in rows if r["key"] not in inside) < 40
    assert possible_hits(keys, "key", bloom.limit(0), 125).where("possible").count() == 0


def test_canonical_urls(value):
    url = "https://A.b/c//?z=1&utm_x=2&a=3&#top"
    assert value(canonical_url(F.col("u")), u=url) == "a.b/c?a=3&z=1"


# --- shards -----------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 70, 1000])
def test_jumps_equal_the_published_ones(spark, n):
    keys = [0, 1, -1, 2**63 - 1, -2**63, *range(100, 400), *[7**k % 2**63 for k in range(20, 90)]]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = frame.select("k", jump_hash(F.col("k"), n).alias("s")).collect()
    assert all(r["s"] == plain.jump(r["k"], n) for r in rows)


def test_shards_are_gapless_and_grow_into_the_new_one(odd_docs, no_docs):
    rows = shard_rows(odd_docs, 3).collect()
    assert len(rows) == odd_docs.count()
    for shard in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 3) for r in rows)
    null = next(r for r in rows if r["doc_id"] == 0)
    assert (null["size"], null["text_crc32"], null["law"]) == (1, 0, "key")
    assert shard_rows(no_docs, 3).count() == 0


def test_other_keys_have_shards_too(spark):
    frame = spark.createDataFrame([("a", "x"), (None, None), ("b", "y")], "name string, text string")
    assert shard_rows(frame, 4, key="name").count() == 3


def test_written_shards(spark, odd_docs, tmp_path):
    write_shards(odd_docs, f"{tmp_path}/s", 4)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == odd_docs.count()
    assert back.where(F.col("shard") != jump_hash(F.col("doc_id"), 4)).count() == 0


# --- personal data ----------------------------------------------------------------------

PRIVATE = [
    "a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 +1 (988) 555-2485, 4111-1111-1111-1111",
    "é😀 x@y.zz, 4111 1111 1111 1111 4111", "1" * 30000 + " 0000001.2.3.255",
    "+1 2 +33 123456789 12345.2.3.4@a.b", "1.2.3.4 " * 300, "a@b.c " * 300, "a" * 5000, None, "",
    "5500-0000-0000-0004 +49 30 1234567 300.1.1.1 1.1.1.1.1",
]
LOOSE = ["call me at 555-234-1234 or phone (212) 555-1234 now", "mail: joe [at] example [dot] com",
         "card 4111.1111.1111.1111 and 1234.5678.9012.3456",
         "my server ip 2001:0db8:85a3:0000:0000:8a2e:0370:7334 ok", "nothing here"]


def spans_of(docs):
    rows = privacy.span_table(docs, ("doc_id", "text")).collect()
    return {r["doc_id"]: [(privacy.KINDS[s["kind"]], s["start"], s["end"], s["base"])
                          for s in r["spans"]] for r in rows}


def test_base_spans_equal_the_patterns(make_docs):
    found = spans_of(make_docs(PRIVATE))
    for i, text in enumerate(PRIVATE):
        assert [s[:3] for s in found[i] if s[3]] == plain.base_spans(text)


def test_base_spans_of_documents(documents, document_rows):
    rows = privacy.span_digest(privacy.span_table(documents)).collect()
    found = {r["doc_id"]: r for r in rows}
    for i, text, _, _ in document_rows:
        spans = plain.base_spans(text)
        assert found[i]["base_sha256"] == plain.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert [found[i][f"n_{k}"] for k in privacy.KINDS] == [
            sum(s[0] == k for s in spans) for k in privacy.KINDS]


def test_method_adds_likely_spans_only(make_docs):
    found = spans_of(make_docs(LOOSE))
    assert [s[:3] for s in found[0]] == [("phone", 11, 23), ("phone", 33, 47)]
    assert [s[:3] for s in found[1]] == [("email", 6, 32)]
    assert [s[:3] for s in found[2]] == [("card", 5, 24)]
    assert [s[:3] for s in found[3]] == [("ip", 13, 52)]
    assert found[4] == []


def test_masking_covers_every_span(make_docs):
    docs = make_docs(PRIVATE)
    spans = spans_of(docs)
    rows = privacy.mask_documents(docs).collect()
    assert rows[0].asDict().keys() == set(docs.columns)
    for r in rows:
        assert r["text"] == plain.masked(PRIVATE[r["doc_id"]],
                                         [s[:3] for s in spans[r["doc_id"]]])


def test_reliable_labelers_are_told_from_random_ones():
    counts = []
    for n, ballot in ((400, (1, 1, 1, 1, 1)), (400, (1, 1, 1, -1, 1)), (400, (0, -1, -1, 1, -1)),
                      (400, (0, -1, -1, -1, -1))):
        counts.append((0, ballot, 0, n))
    model = privacy.fit_model(counts)
    assert min(model.reliability[1], model.reliability[2]) > 0.9 > 0.7 > model.reliability[3]
    assert 0.4 < model.prior[0] < 0.6


def test_private_odd_rows(odd_docs, no_docs):
    assert privacy.span_table(odd_docs).count() == odd_docs.count()
    assert privacy.span_table(no_docs).count() == 0
    assert privacy.mask_documents(no_docs).columns == no_docs.columns


# --- quality ----------------------------------------------------------------------------


def test_counts(documents, document_rows, odd_docs):
    for docs in (documents, odd_docs):
        texts = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
        found = {r["doc_id"]: tuple(r)[1:6] for r in quality.judge_quality(docs).select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
        ).collect()}
        assert all(found[i] == plain.quality_counts(t) for i, t in texts)


def test_verdicts_equal_the_plain_method(spark, document_rows):
    docs = spark.createDataFrame(document_rows, "doc_id long, text string, lang string, source string")
    wanted = plain.kept_by_quality(document_rows, quality.LEAST_SPREAD, 30, quality.CUTOFF)
    rows = quality.judge_quality(docs, least_rows=30).collect()
    assert {r["doc_id"]: r["kept"] for r in rows} == wanted


def test_junk_goes_and_clean_text_stays(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality.judge_quality(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1]
    bad = [r["kept"] for r in judged if r["quality"] == 0]
    assert all(good) and sum(bad) <= 0.1 * len(bad)


def test_repeated_short_lines_alone_can_reject(spark):
    rng = random.Random(8)

    def paragraph():
        return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(60))

    clean = [(i, "\n".join(paragraph() for _ in range(10)), "en", "web") for i in range(300)]
    odd = [(1000 + i, "\n".join(f"{paragraph()}\nShare\nLike\nMore" for _ in range(10)), "en", "web")
           for i in range(5)]
    docs = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string")
    rows = quality.judge_quality(docs).collect()
    assert not any(r["base_failed"] for r in rows)
    assert {r["doc_id"] for r in rows if not r["kept"]} == {i for i, *_ in odd}


def test_core_of_a_group_with_a_far_cluster(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.3, (240, 4)), rng.normal(3, 0.1, (60, 4))])
    rows = spark.createDataFrame([("a", *map(float, r)) for r in x], "g string, x0 double, x1 double,"
                                 " x2 double, x3 double")
    core = quality.fit_core(rows)
    found = quality._measured(rows, core).selectExpr("x0", "d2 / scale AS d").collect()
    wanted = dict(zip(x[:, 0], plain.core_distances(x, quality.LEAST_SPREAD)))
    assert all(r["d"] == pytest.approx(wanted[r["x0"]], rel=1e-6) for r in found)
    assert min(r["d"] for r in found if r["x0"] > 2) > quality.CUTOFF


def test_quality_odd_rows(odd_docs, no_docs):
    rows = quality.judge_quality(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = {r["doc_id"]: r for r in rows}
    assert found[0]["base_failed"] and not found[0]["kept"] and not found[6]["kept"]
    assert quality.judge_quality(no_docs).count() == 0
    kept = quality.keep_good_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r["kept"] for r in rows)

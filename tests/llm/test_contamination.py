"""Benchmark passages against a plain search of all windows."""

import random

import pytest

from facetlake.llm import contamination
from facetlake.llm.contamination import judge_contamination, shared_passages
from tests.llm import plain


def judged(docs, items, **more):
    return sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["item_ids"], r["n_items"],
                   r["contaminated"]) for r in judge_contamination(docs, items, **more).collect())


def wanted(texts, items, ids=None, window=10):
    found = plain.contamination(texts, items, window)
    ids = range(len(texts)) if ids is None else ids
    return sorted((repr(i), n, hit, names, len(names), hit > 0)
                  for i, (n, hit, names) in zip(ids, found))


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("window, gram", [(10, 5), (10, 10), (10, 1), (4, 2)])
def test_random_texts_of_few_words(spark, make_docs, window, gram):
    """Two or four words only: nearly everything is shared, and ties abound."""
    rng = random.Random(window * 100 + gram)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60)))
             for words in ("ab", "abcd") for _ in range(60)]
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40))))
             for i in range(25)]
    assert judged(make_docs(texts), items_of(spark, items), window=window, gram=gram) == wanted(
        texts, items, window=window)


def test_odd_texts_and_items(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, None), (2, ""), (3, "...!"), (4, "Solo"), (5, "Two  WORDS"), (6, long),
             (6, long), (7, " ".join(f"w{i}" for i in range(5, 30))), (None, "né tz"),
             (8, "é" * 5000), (9, "a b c d e f g h i j")]
    texts = [None, "", "!", "solo", "SOLO, two-words two\nwords", long.upper(),
             long.replace("w20", "x"), "w1 " * 20, "NÉ tz né tz", "é" * 5000, "é" * 4999,
             "a b c d e f g h i j", "b c d e f g h i j k", "x" * 200_000, "solo"]
    ids = [*range(len(texts) - 2), None, 3]
    assert judged(make_docs(texts, ids), items_of(spark, items)) == wanted(texts, items, ids)


def test_words_beside_other_texts_are_no_window(spark, make_docs):
    words = [f"w{i}" for i in range(10)]
    texts = [" ".join(words[:5]), " ".join(words[5:]), " ".join(words)]
    rows = judge_contamination(make_docs(texts).coalesce(1), items_of(spark, [(1, " ".join(words))]))
    assert sorted(r["n_hit"] for r in rows.collect()) == [0, 0, 10]


def test_a_full_filter_and_a_shuffled_join(spark, make_docs, monkeypatch):
    """Beyond both bounds the results stay the same."""
    monkeypatch.setattr(contamination, "MAX_BLOCKS", 1)
    monkeypatch.setattr(contamination, "BROADCAST_BYTES", 0)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(50)) for _ in range(40)]
    items = [(i, " ".join(rng.choice("abc") for _ in range(30))) for i in range(20)]
    assert judged(make_docs(texts), items_of(spark, items)) == wanted(texts, items)


def test_spans_cover_the_hits(spark, make_docs):
    words = [f"w{i}" for i in range(30)]
    texts = ["x y " + " ".join(words[4:20]) + " z"]
    rows = shared_passages(make_docs(texts), items_of(spark, [(9, " ".join(words))])).collect()
    assert {r["item_id"] for r in rows} == {9}
    assert {p for r in rows for p in range(r["first"], r["end"])} == set(range(2, 18))


def test_empty_tables(spark, make_docs, no_docs):
    some, none = items_of(spark, [(1, "a b")]), items_of(spark, [(1, "a b")]).limit(0)
    assert judged(no_docs, some) == []
    assert judged(make_docs(["a b", None]), none) == wanted(["a b", None], [])

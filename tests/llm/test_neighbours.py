"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake.llm.neighbours import nearest_vectors

SCHEMA = "vec_id long, embedding array<float>, node string, d int"


def brute(rows, is_query, k):
    usable = {i: np.array(v, dtype=np.float64) for i, v in rows}
    out = {}
    for q, x in usable.items():
        if is_query(q):
            order = sorted((float(np.sqrt(((x - y) ** 2).sum())), i)
                           for i, y in usable.items() if i != q)
            out[q] = order[:k]
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 16))
    x = (centres[rng.integers(0, 8, 1500)] + 0.4 * rng.standard_normal((1500, 16))).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    same = x[77].tolist()
    return rows + [(10_000 + i, same) for i in range(400)]


def test_recall_and_exact_scores(spark, clustered):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in clustered], SCHEMA).repartition(4)
    wanted = brute(clustered, lambda i: i % 25 == 0, 10)
    found = {}
    for r in nearest_vectors(frame, F.col("vec_id") % 25 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert found.keys() == wanted.keys()
    vectors, hits = dict(clustered), 0
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)
        for _, score, i in rows:
            a, b = np.array(vectors[q], "f8"), np.array(vectors[i], "f8")
            assert score == pytest.approx(np.sqrt(((a - b) ** 2).sum()), abs=1e-9)
        hits += len({i for _, _, i in rows} & {i for _, i in wanted[q]})
    assert hits >= 0.9 * sum(map(len, wanted.values()))
    # Among equal vectors the smallest ids come first.
    assert [i for _, _, i in found[10_000]][:3] == [77, 10_001, 10_002]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0]),
            (9, [1.0, 0.0]), (10, [3.0, 3.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    found = nearest_vectors(frame, F.lit(True), k=3).collect()
    lists = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        lists.setdefault(r["query_id"], []).append(r["vec_id"])
    assert lists == {0: [9, 1, 10], 1: [0, 9, 10], 9: [0, 1, 10], 10: [0, 1, 9]}
    assert nearest_vectors(frame.limit(0), F.lit(True)).count() == 0


def test_the_whole_table_decides_on_the_length(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(30)] + [(100, [1.0, 2.0, 3.0]), (200, [3.0] * 3)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    found = nearest_vectors(frame, F.col("vec_id").isin(5, 100, 200), k=2).collect()
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in found} == {(5, 4, 1.0), (5, 6, 1.0)}


def test_recall_beside_vectors_of_very_large_norm(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 8000)] + 0.4 * rng.standard_normal((8000, 16))
    x[:3] *= 1e5
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype("f4"))]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(4)
    wanted = brute(rows, lambda i: i % 200 == 7, 10)
    found = {}
    for r in nearest_vectors(frame, F.col("vec_id") % 200 == 7).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(found[q] & {i for _, i in best}) for q, best in wanted.items())
    assert hits >= 0.9 * sum(map(len, wanted.values()))

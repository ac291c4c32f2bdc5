"""The manifest against a plain tree, and the layout's addresses."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake.llm import merkle
from facetlake.llm.merkle import address, build_manifest, folded, leaf_paths, n_nodes, prove, verify
from tests.llm import plain

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


@pytest.mark.parametrize("levels", range(1, 9))
def test_addresses_are_a_layout(levels):
    places = [address(d, np.arange(3 ** d), levels) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(n_nodes(levels)))
    assert places[0].tolist() == [0]


def test_lower_subtrees_lie_together():
    """Four levels: two above, then nine subtrees of two levels each."""
    roots = address(2, np.arange(9), 4)
    assert roots.tolist() == [4 + 4 * i for i in range(9)]
    children = address(3, np.arange(27), 4)
    assert (children // 4).tolist() == [1 + i // 3 for i in range(27)]


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9, 10, 26, 27])
def test_proofs_of_a_block(size):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(size)]
    nodes = merkle.laid_out(leaves, 3)
    levels = plain.merkle_root([x.hex() for x in leaves])
    root = levels[-1][0]
    for _ in range(len(levels) - 1, 3):
        root = hashlib.sha256(root.encode()).hexdigest()
    assert nodes[:32].hex() == root
    for leaf, path in zip(leaves, leaf_paths(nodes, size, 3, b"")):
        assert folded(leaf, path).hex() == root
        assert folded(leaves[0][::-1], path).hex() != root


def rows_of(docs, height):
    manifest = build_manifest(docs, COLUMNS, carried={"claim": merkle.leaf_digest(
        [*[docs[c] for c in COLUMNS[:-1]], F.upper(docs["text"])])}, height=height)
    honest = verify(prove(manifest), "leaf").collect()
    assert all(bytes(r["folded"]) == manifest.root for r in honest)
    for r in verify(prove(manifest), "claim").collect():
        same = bytes(r["claim"]) == bytes(r["leaf"])
        assert (bytes(r["folded"]) == manifest.root) == same
    return sorted((repr(r["key"]), *[bytes(x).hex() for x in (
        r["leaf"], r["subroot"], manifest.root, r["siblings"])]) for r in honest)


def wanted(docs):
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    return sorted((repr(r[0]), *r[1:]) for r in plain.merkle_rows(rows))


@pytest.mark.parametrize("height", [1, 2, 6])
def test_documents_against_plain(documents, height):
    docs = documents.withColumn("source", F.when(F.col("doc_id") % 3 != 0, "hot").otherwise(
        F.col("source")))
    assert rows_of(docs, height) == wanted(docs)


@pytest.mark.parametrize("height", [1, 6])
def test_odd_rows(odd_docs, height):
    docs = odd_docs.unionByName(odd_docs).withColumn(
        "source", F.expr("CASE WHEN doc_id % 5 = 0 THEN 'é' WHEN doc_id % 5 = 1 THEN '' "
                         "WHEN doc_id % 5 = 2 THEN 'Z' END"))
    assert rows_of(docs, height) == wanted(docs)


def test_powers_of_three(spark):
    """Groups that fill their last block exactly need one more layer."""
    docs = spark.range(9 + 27 + 1).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 9, "a").when(F.col("id") < 36, "b")
        .otherwise("c").alias("source"), F.lit("en").alias("lang"),
        F.lit(None).cast("long").alias("n_chars"), F.lit("t").alias("text"))
    assert rows_of(docs, 2) == wanted(docs)
    assert rows_of(docs.where("id = 3"), 2) == wanted(docs.where("id = 3"))


def test_no_rows(no_docs):
    manifest = build_manifest(no_docs)
    assert manifest.root is None
    assert verify(prove(manifest), "leaf").collect() == []

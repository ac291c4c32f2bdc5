"""Approximate nearest neighbours: NN-descent builds a graph, greedy search walks it.

Equal vectors are one node, so that a vector held by a third of all rows costs one node and never
fills a neighbourhood. The graph starts from random projections: nodes sorted by the signs of a
few projections are cut into even blocks, and each block compares its members. Then NN-descent:
every node brings its neighbours and reverse neighbours together, in joins, and pairs of them that
beat the lists they would enter become edges. A search keeps the nearest nodes found per query and
expands, in each round, those not yet expanded, until none is left. Building and searching measure
the original components in double precision: no scale is shared, so that a few vectors of very
large norm take nothing from the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.llm.scratch import small, stored
from facetlake.operators.numbering import global_positions

DEGREE = 24
TREES = 6
BLOCK = 128
SETTLED = 0.01  # NN-descent ends when a smaller share of all list entries changes in a round
BEAM = 256
ENTRIES = 64
_EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                       T.StructField("d", T.DoubleType())])


@dataclass(frozen=True)
class Graph:
    """``nodes``: node, vec, all of ``length``; ``edges``: a, b, d (both directions);
    ``members``: node, vec_id."""

    nodes: DataFrame
    edges: DataFrame
    members: DataFrame
    length: int


def sound(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``vec_id, vec``: vectors without null or non-finite components, not all zero."""
    vec = vectors[vector].cast("array<double>")
    return vectors.select(vectors[id_column].alias("vec_id"), vec.alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0))


def commonest_length(rows: DataFrame) -> int:
    """The length of most ``vec``, the longer one if two are as frequent; 0 without rows."""
    found = rows.groupBy(F.size("vec").alias("n")).count().orderBy(
        F.desc("count"), F.desc("n")).first()
    return found["n"] if found else 0


def _nodes(rows: DataFrame, members_kept: int) -> tuple[DataFrame, DataFrame]:
    """``node, vec`` of distinct vectors, and ``node, vec_id`` of the smallest ids of each."""
    keyed = rows.select("vec_id", "vec", F.xxhash64("vec").alias("h1"),
                        F.xxhash64("vec", F.lit(1)).alias("h2"))
    least = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"))
    one = keyed.join(least, ["h1", "h2", "vec_id"]).dropDuplicates(["h1", "h2"])
    nodes = stored(global_positions(one, [F.col("vec_id"), F.col("h1"), F.col("h2")], "node"),
                   "ann-nodes")
    by_id = Window.partitionBy("h1", "h2").orderBy("vec_id")
    first = keyed.select("h1", "h2", "vec_id").distinct().withColumn(
        "place", F.row_number().over(by_id)).where(F.col("place") <= members_kept)
    members = stored(first.join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select(
        "node", "vec_id"), "ann-members")
    return nodes.select("node", "vec"), members


def _coded(nodes: DataFrame, bits: int, width: str) -> DataFrame:
    """``node, v, codes, lines``: the bytes of all components, and for each tree the signs of
    ``bits`` random projections and one projection more."""
    schema = T.StructType([
        T.StructField("node", T.LongType()), T.StructField("v", T.BinaryType()),
        T.StructField("codes", T.ArrayType(T.LongType())),
        T.StructField("lines", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            planes = np.random.default_rng(7).standard_normal((TREES, bits + 1, x.shape[1]))
            sides = np.einsum("nd,tbd->ntb", x, planes)
            weights = np.int64(1) << np.arange(bits, dtype=np.int64)
            codes = ((sides[:, :, :bits] > 0) * weights).sum(axis=2)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([row.tobytes() for row in x.astype(width)], pa.binary()),
                pa.array(codes.tolist(), pa.list_(pa.int64())),
                pa.array(sides[:, :, bits].tolist(), pa.list_(pa.float64()))],
                names=schema.names)

    return nodes.mapInArrow(run, schema)


def _squares(x: np.ndarray) -> np.ndarray:
    norms = (x * x).sum(axis=1)
    return np.maximum(norms[:, None] + norms[None, :] - 2 * (x @ x.T), 0)


def _apart(table: pa.Table, key: str) -> Iterator[pa.Table]:
    """The rows of each value of ``key``."""
    table = table.sort_by(key)
    values = table.column(key).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1), len(values)]
    for a, b in zip(cuts, cuts[1:]):
        yield table.slice(a, b - a)


def _vectors_of(table: pa.Table, width: str) -> np.ndarray:
    rows = table.column("v").to_pylist()
    return np.frombuffer(b"".join(rows), width).reshape(len(rows), -1).astype(np.float64)


def _edge_table(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    a, b, d = (np.concatenate(c) for c in zip(*parts)) if parts else ([], [], [])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                     pa.array(d, pa.float64())], names=_EDGES.names)


def _block_edges(degree: int, width: str) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        parts = []
        for block in _apart(table, "block"):
            ids = block.column("node").to_numpy()
            d = _squares(_vectors_of(block, width))
            np.fill_diagonal(d, np.inf)
            k = min(degree, len(ids) - 1)
            if k > 0:
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                parts.append((np.repeat(ids, k), ids[near].ravel(),
                              np.take_along_axis(d, near, axis=1).ravel()))
        return _edge_table(parts)

    return run


def _nearest(edges: DataFrame, degree: int) -> DataFrame:
    order = Window.partitionBy("a").orderBy("d", "b")
    return edges.groupBy("a", "b").agg(F.min("d").alias("d")).withColumn(
        "place", F.row_number().over(order)).where(F.col("place") <= degree).drop("place")


def _projected(coded: DataFrame, degree: int, width: str) -> DataFrame:
    """Edges within even blocks of nodes that lie on the same sides of random planes."""
    found = None
    for tree in range(TREES):
        keys = coded.select("node", F.get("codes", tree).alias("code"),
                            F.get("lines", tree).alias("line"))
        placed = global_positions(keys, [F.col("code"), F.col("line"), F.col("node")], "place")
        blocked = placed.select("node", F.floor((F.col("place") - 1) / BLOCK).alias("block")).join(
            coded.select("node", "v"), "node").withColumn("part", F.floor(F.col("block") / 8))
        edges = blocked.groupBy("part").applyInArrow(_block_edges(degree, width), _EDGES)
        found = edges if found is None else found.union(edges)
    return _nearest(found, degree)


def _local_join(width: str) -> Callable[[pa.Table], pa.Table]:
    """Pairs of the neighbours of each node that beat the list of one of the two."""
    def run(table: pa.Table) -> pa.Table:
        parts = []
        for group in _apart(table, "at"):
            ids = group.column("node").to_numpy()
            new = group.column("new").to_numpy(zero_copy_only=False)
            radius = group.column("radius").to_numpy()
            d = _squares(_vectors_of(group, width))
            fresh = (new[:, None] | new[None, :]) & (ids[:, None] != ids[None, :])
            i, j = np.nonzero(fresh & (d < radius[:, None]))
            if len(i):
                parts.append((ids[i], ids[j], d[i, j]))
        if not parts:
            return _edge_table(parts)
        a, b, d = (np.concatenate(c) for c in zip(*parts))
        _, once = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True)
        return _edge_table([(a[once], b[once], d[once])])

    return run


def _with_reverse(edges: DataFrame, degree: int) -> DataFrame:
    """``at, node, d``: every node's neighbours and its nearest reverse neighbours."""
    order = Window.partitionBy("b").orderBy("d", "a")
    back = edges.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= degree).select(F.col("b").alias("at"), F.col("a").alias("node"), "d")
    ahead = edges.select(F.col("a").alias("at"), F.col("b").alias("node"), "d")
    return ahead.union(back).groupBy("at", "node").agg(F.min("d").alias("d"))


def build_graph(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding",
    degree: int = DEGREE, settled: float = SETTLED, members_kept: int = 11,
) -> Graph:
    """The graph over all usable vectors; at least ``members_kept`` neighbours can be named for
    any group of equal vectors. Rounds go on while more than the share ``settled`` of the list
    entries change."""
    rows = sound(vectors, id_column, vector)
    length = commonest_length(rows)
    nodes, members = _nodes(rows.where(F.size("vec") == length), members_kept)
    n = nodes.count()
    bits = max(1, int(np.ceil(np.log2(max(2, n / BLOCK)))))
    # As wide as the table's own components, so nothing is rounded.
    component = vectors.schema[vector].dataType.elementType
    width = "<f4" if component == T.FloatType() else "<f8"
    coded = stored(_coded(nodes, bits, width), "ann-coded")
    edges = stored(_projected(coded, degree, width), "ann-edges0")
    before, step, entries, changed = None, 0, edges.count(), np.inf
    while changed > settled * entries:
        step += 1
        near = _with_reverse(edges, degree)
        if before is None:
            near = near.withColumn("new", F.lit(True))
        else:
            old = before.select(F.col("a").alias("at"), F.col("b").alias("node")).union(
                before.select("b", "a")).distinct().withColumn("old", F.lit(True))
            near = near.join(old, ["at", "node"], "left").withColumn(
                "new", F.col("old").isNull()).drop("old")
        full = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).select(
            F.col("a").alias("node"), F.when(F.col("n") >= degree, F.col("d")).otherwise(
                F.lit(float("inf"))).alias("radius"))
        known = coded.select("node", "v").join(full, "node")
        met = near.select("at", "node", "new").join(known, "node").withColumn(
            "part", F.pmod(F.xxhash64("at"), F.lit(max(1, n // 512))))
        pairs = met.groupBy("part").applyInArrow(_local_join(width), _EDGES)
        before, edges = edges, stored(_nearest(edges.union(pairs), degree), f"ann-edges{step}")
        entries = edges.count()
        changed = edges.join(before, ["a", "b"], "left_anti").count()
    both = stored(_with_reverse(edges, degree).toDF("a", "b", "d"), "ann-graph")
    return Graph(nodes, both, members, length)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda s, x: s + x))


def search_graph(
    graph: Graph, queries: DataFrame, k: int, beam: int = BEAM, entries: int = ENTRIES
) -> DataFrame:
    """``query_id, node, score``: the ``beam`` nearest nodes found for each query.

    ``queries``: query_id, vec, start (a node to begin with, or null). Every query also begins
    with the nearest four of ``entries`` fixed nodes.
    """
    asked = stored(queries.select("query_id", "vec", "start"), "ann-queries")
    target = small(asked.select("query_id", F.col("vec").alias("target")), 1024)
    # A fixed number of entry nodes against the stated queries.
    gates = graph.nodes.orderBy(F.xxhash64("node"), "node").limit(entries)
    first = target.crossJoin(F.broadcast(gates)).select(
        "query_id", "node", distance(F.col("target"), F.col("vec")).alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "node")
    first = first.withColumn("place", F.row_number().over(best)).where("place <= 4").drop("place")
    own = asked.where("start IS NOT NULL").join(
        graph.nodes, F.col("start") == F.col("node")).select(
        "query_id", "node", distance(asked["vec"], graph.nodes["vec"]).alias("score"))
    state = stored(first.union(own).distinct().withColumn("done", F.lit(False)), "ann-state")
    while True:
        front = state.where("NOT done").select("query_id", F.col("node").alias("a"))
        if front.isEmpty():
            return state.select("query_id", "node", "score")
        met = front.join(graph.edges.select("a", F.col("b").alias("node")), "a").select(
            "query_id", "node").distinct()
        new = met.join(state.select("query_id", "node"), ["query_id", "node"], "left_anti")
        measured = new.join(graph.nodes, "node").join(target, "query_id").select(
            "query_id", "node", distance(F.col("target"), F.col("vec")).alias("score"),
            F.lit(False).alias("done"))
        seen = state.withColumn("done", F.lit(True)).select("query_id", "node", "score", "done")
        # Nodes outside the beam are forgotten: meeting one again only measures it again, since
        # the beam never gets worse.
        state = stored(seen.union(measured).withColumn(
            "place", F.row_number().over(best)).where(F.col("place") <= max(beam, k + 1)).drop(
            "place"), "ann-state")


def nearest_vectors(
    vectors: DataFrame, is_query: Column, k: int = 10,
    id_column: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other vectors found for each row of
    ``vectors`` for which ``is_query`` holds, ties to smaller ids.

    Defined cases: vectors that are null, zero, of another length than most rows of the whole
    table, or hold null or non-finite components take no part, nor do null ids; equal vectors are at distance 0 and
    found by their smallest ids; rows with equal id and vector are one; with fewer than ``k``
    candidates all are returned; an empty table gives no rows. Reads only the two named columns.
    """
    graph = build_graph(vectors, id_column, vector, members_kept=k + 1)
    chosen = sound(vectors.where(is_query), id_column, vector).where(
        F.size("vec") == graph.length).distinct()
    keyed = graph.nodes.select("node", F.xxhash64("vec").alias("h1"),
                               F.xxhash64("vec", F.lit(1)).alias("h2"))
    queries = chosen.withColumn("h1", F.xxhash64("vec")).withColumn(
        "h2", F.xxhash64("vec", F.lit(1))).join(keyed, ["h1", "h2"], "left").select(
        F.col("vec_id").alias("query_id"), "vec", F.col("node").alias("start"))
    found = search_graph(graph, queries, k)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.join(graph.members, "node").where("vec_id <> query_id").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")

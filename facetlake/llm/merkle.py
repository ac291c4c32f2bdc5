"""A Merkle manifest of a table: trees of three children over all rows, in van Emde Boas layout.

The rows of each group (a source) are the leaves of its tree, in the order of their key; the roots
of all groups are the leaves of one more tree. A tree is cut into aligned blocks of ``HEIGHT``
levels, whose roots are the leaves of the next layer of blocks, until one block is left. A block is
one row of a table: its nodes lie in one binary cell, the upper half of its levels first, then the
subtrees below one after the other, each cut at half its height again. The place of a node follows
by arithmetic from its level and index alone (``address``); building and the look-up of siblings
both use it. A block has at most 3^``HEIGHT`` leaves, so a group of any size is spread over tasks.

Digests are SHA-256 over the hexadecimal text of the children, kept as 32 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.llm.scratch import stored
from facetlake.operators.numbering import global_positions
from facetlake.session import cut_lineage

ARITY = 3
HEIGHT = 6
DIGEST = 32
_BLOCKS = "grp long, block long, size int, height int, done boolean, nodes binary, root binary"


def n_nodes(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (ARITY ** levels - 1) // (ARITY - 1)


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places of the nodes ``index`` of the level ``depth`` (0: the root) of a full tree."""
    place = np.zeros_like(index)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        depth, levels = depth - upper, levels - upper
        below = ARITY ** depth
        place = place + n_nodes(upper) + (index // below) * n_nodes(levels)
        index = index % below
    return place


@lru_cache(maxsize=64)
def _places(height: int, size: int) -> list[np.ndarray]:
    """For each level from the leaves up, the places of the nodes that a tree of ``size`` leaves
    has there."""
    return [address(height - up, np.arange(-(-size // ARITY ** up)), height + 1)
            for up in range(height + 1)]


def parents(digests: list[bytes]) -> list[bytes]:
    """The next level: each run of three digests becomes one; the last run may be shorter."""
    texts = [d.hex() for d in digests]
    return [sha256("".join(texts[i:i + ARITY]).encode()).digest()
            for i in range(0, len(texts), ARITY)]


def laid_out(leaves: list[bytes], height: int) -> bytes:
    """The nodes of a tree in van Emde Boas order; places without a node hold zeros."""
    nodes = np.zeros((n_nodes(height + 1), DIGEST), dtype=np.uint8)
    level = leaves
    for places in _places(height, len(leaves)):
        nodes[places] = np.frombuffer(b"".join(level), dtype=np.uint8).reshape(-1, DIGEST)
        level = parents(level)
    return nodes.tobytes()


def leaf_paths(nodes: bytes, size: int, height: int, upper: bytes) -> list[bytes]:
    """The proof of every leaf of a block, ending with the proof ``upper`` of its root.

    A step is a byte (four times the place in the run, plus the run's length) and the digests of
    the others of the run.
    """
    paths = [upper]
    places = _places(height, size)
    for up in range(height - 1, -1, -1):
        level = [nodes[p * DIGEST:(p + 1) * DIGEST] for p in places[up].tolist()]
        found = []
        for parent, path in enumerate(paths):
            run = level[ARITY * parent:ARITY * (parent + 1)]
            for i in range(len(run)):
                step = bytes([4 * i + len(run)]) + b"".join(run[:i]) + b"".join(run[i + 1:])
                found.append(step + path)
        paths = found
    return paths


def folded(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and a proof lead to."""
    digest, at = leaf, 0
    while at < len(proof):
        place, size = divmod(proof[at], 4)
        cut = at + 1 + DIGEST * place
        at += 1 + DIGEST * (size - 1)
        text = proof[at - DIGEST * (size - 1):cut].hex() + digest.hex() + proof[cut:at].hex()
        digest = sha256(text.encode()).digest()
    return digest


def siblings(proof: bytes) -> str:
    """The digests of a proof from the leaf up, left to right, as text."""
    texts, at = [], 0
    while at < len(proof):
        end = at + 1 + DIGEST * (proof[at] % 4 - 1)
        texts.append(proof[at + 1:end].hex())
        at = end
    return "".join(texts)


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 over ``-`` for each null and byte count, colon and value for all others."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
             for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


@dataclass(frozen=True)
class Manifest:
    """Stored tables. ``leaves``: grp, at, key, group, leaf and carried columns; ``layers``: the
    blocks over them, lowest first; ``subroots``: grp, at, digest; ``top``: the blocks over
    those; ``root``: None for an empty table; ``height``: levels of a block above its leaves."""

    leaves: DataFrame
    layers: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: bytes | None
    height: int


def _same(codes: np.ndarray) -> np.ndarray:
    """Starts of runs of equal numbers."""
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else (
        np.zeros(0, dtype=np.int64))


def _numbered(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``grp`` (a number of the group, in the groups' order) and ``at`` (place in
    it, from 0).

    The rows are sorted by range once. What a partition must know of those before it is where
    its first group begins: one small row per partition is gathered for that.
    """
    ordered = cut_lineage(rows.orderBy(*order))

    def runs(values: pa.Array) -> np.ndarray:
        return _same(values.dictionary_encode(null_encoding="encode").indices.to_numpy())

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, last, begin = 0, None, None, 0
        for batch in batches:
            values = batch.column(0)
            if not len(values):
                continue
            starts = runs(values)
            if n == 0:
                first = values[0].as_py()
            if n == 0 or len(starts) > 1 or values[0].as_py() != last:
                same = n > 0 and len(starts) == 1 and values[0].as_py() == last
                begin = begin if same else n + int(starts[-1])
            last = values[-1].as_py()
            n += len(values)
        if n:
            yield pa.RecordBatch.from_pydict({
                "part": [TaskContext.get().partitionId()], "n": [n], "begin": [begin],
                "first": pa.array([first], kind), "last": pa.array([last], kind)})

    kind = pa.string()
    named = ordered.select(F.col(group).cast("string").alias("g"))
    # One row per partition of the sort.
    parts = sorted(named.mapInArrow(
        summary, "part long, n long, begin long, first string, last string").collect())
    at, starts, current = 0, {}, None
    for part, n, begin, first, last in parts:
        if current is None or current[0] != first:
            current = (first, at)
        starts[part] = (at, current[1])
        if begin > 0 or current[0] != last:
            current = (last, at + begin)
        at += n

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, begin = starts.get(TaskContext.get().partitionId(), (0, 0))
        last, seen = None, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column(batch.schema.get_field_index(group)).cast(pa.string())
            first_of = runs(values) + place
            if not seen or values[0].as_py() == last:
                first_of[0] = begin
            begin, last, seen = int(first_of[-1]), values[-1].as_py(), True
            sizes = np.diff(np.append(runs(values), n))
            grp = np.repeat(first_of, sizes)
            at = np.arange(place, place + n) - grp
            place += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(grp, pa.int64()), pa.array(at, pa.int64()), *batch.columns],
                names=["grp", "at", *batch.schema.names])

    schema = T.StructType([T.StructField("grp", T.LongType()), T.StructField("at", T.LongType()),
                           *ordered.schema.fields])
    return ordered.mapInArrow(number, schema)


def _block_rows(height: int):
    """Rows (grp, at, digest), sorted, become one row per block."""
    width = ARITY ** height

    def block(grp: int, number: int, leaves: list[bytes]) -> tuple:
        done = number == 0 and len(leaves) < width
        tall = height
        if done:
            tall = 0
            while ARITY ** tall < len(leaves):
                tall += 1
        nodes = laid_out(leaves, tall)
        return grp, number, len(leaves), tall, done, nodes, nodes[:DIGEST]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []
        names = [f.split()[0] for f in _BLOCKS.split(", ")]

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (
                pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(),
                pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for part in batches:
            grp, at = (part.column(i).to_numpy() for i in (0, 1))
            digests, number = part.column(2), at // width
            starts = np.union1d(_same(grp), _same(number)).tolist()
            for a, b in zip(starts, [*starts[1:], len(grp)]):
                here = (int(grp[a]), int(number[a]))
                if key is not None and here != key:
                    out.append(block(*key, held))
                    held = []
                    if len(out) >= 64:
                        yield batch()
                        out = []
                key = here
                held += digests.slice(a, b - a).to_pylist()
        if key is not None:
            out.append(block(*key, held))
        if out:
            yield batch()

    return rows


def _layers(rows: DataFrame, height: int, name: str) -> list[DataFrame]:
    """Layers of blocks over rows (grp, at, digest), lowest first."""
    layers, width = [], ARITY ** height
    while True:
        dealt = rows.select("grp", "at", "digest").repartition(
            F.col("grp"), F.floor(F.col("at") / width)).sortWithinPartitions("grp", "at")
        layers.append(stored(dealt.mapInArrow(_block_rows(height), _BLOCKS), name))
        going = layers[-1].where("not done")
        if going.isEmpty():
            return layers
        rows = going.select("grp", F.col("block").alias("at"), F.col("root").alias("digest"))


def _roots(layers: list[DataFrame]) -> DataFrame:
    found = [x.where("done").select("grp", F.col("root").alias("digest")) for x in layers]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def build_manifest(
    docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    key: str = "doc_id", group: str = "source", carried: Mapping[str, Column] | None = None,
    height: int = HEIGHT,
) -> Manifest:
    """The manifest of all rows of ``docs``; ``carried`` names further columns of ``leaves``.

    A leaf is ``leaf_digest`` of ``columns``. Groups are ordered bytewise, leaves by key and
    then by digest, nulls first.

    Defined cases: a null group is a group of its own, a null key one more key; repeated keys
    and rows are leaves of their own; a null value differs from an empty one; an empty table has
    no leaves and the root None. Only the named columns are read, whatever others are called.
    """
    if height < 1:
        raise ValueError("a block has a level above its leaves at least")
    leaves = stored(docs.select(
        docs[key].alias("key"), docs[group].alias("group"),
        leaf_digest([docs[c] for c in columns]).alias("leaf"),
        *[c.alias(n) for n, c in (carried or {}).items()]), "merkle-leaves")
    numbered = stored(_numbered(leaves, "group", [
        F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf")]),
        "merkle-numbered")
    layers = _layers(numbered.withColumnRenamed("leaf", "digest"), height, "merkle-blocks")
    placed = global_positions(_roots(layers), [F.col("grp")], "place")
    subroots = stored(placed.select("grp", (F.col("place") - 1).alias("at"), "digest"),
                      "merkle-subroots")
    top = _layers(subroots.withColumn("grp", F.lit(0).cast("long")), height, "merkle-top")
    whole = _roots(top).first()
    return Manifest(numbered, layers, subroots, top, bytes(whole["digest"]) if whole else None,
                    height)


def _with_upper(blocks: DataFrame, uppers: DataFrame | None) -> DataFrame:
    """Blocks with the proof of their root (``upper``) and the root of their group."""
    if uppers is None:
        return blocks.withColumns({"upper": F.lit(b""), "subroot": F.col("root")})
    found = blocks.join(uppers.withColumnRenamed("at", "block"), ["grp", "block", "done"], "left")
    return found.withColumn("subroot", F.coalesce("subroot", "root"))


def _leaf_paths(blocks: DataFrame, height: int) -> DataFrame:
    """``grp, at, upper, subroot`` of every leaf of the blocks."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1).to_pylist()[0]
                paths = leaf_paths(b["nodes"], b["size"], b["height"], b["upper"])
                first = b["block"] * ARITY ** height
                yield pa.RecordBatch.from_arrays([
                    pa.array([b["grp"]] * len(paths), pa.int64()),
                    pa.array(range(first, first + len(paths)), pa.int64()),
                    pa.array(paths, pa.binary()),
                    pa.array([b["subroot"]] * len(paths), pa.binary()),
                ], names=["grp", "at", "upper", "subroot"])

    return blocks.mapInArrow(rows, "grp long, at long, upper binary, subroot binary")


def _block_uppers(manifest: Manifest) -> DataFrame:
    """The lowest blocks over the rows, with the proofs of their roots: downwards from the root,
    each layer's proofs are those of the next one's leaves."""
    uppers = None
    for blocks in reversed(manifest.top):
        paths = _leaf_paths(_with_upper(blocks, uppers), manifest.height)
        uppers = stored(paths.withColumn("done", F.lit(False)), "merkle-top-paths")
    of_groups = stored(
        uppers.select("at", "upper").join(manifest.subroots.select("at", "grp"), "at").select(
            "grp", F.lit(0).cast("long").alias("at"), "upper",
            F.lit(None).cast("binary").alias("subroot"), F.lit(True).alias("done")),
        "merkle-group-paths")
    uppers = of_groups
    for blocks in reversed(manifest.layers[1:]):
        paths = _leaf_paths(_with_upper(blocks, uppers), manifest.height)
        going = stored(paths.withColumn("done", F.lit(False)), "merkle-paths")
        uppers = of_groups.unionByName(going)
    return _with_upper(manifest.layers[0], uppers)


def prove(manifest: Manifest) -> DataFrame:
    """The leaves, each with ``subroot`` and ``proof`` (see ``leaf_paths``), up to the root.

    Rows meet their block in one exchange by block, the block first; a task holds the proofs of
    one block at a time.
    """
    leaves, names = manifest.leaves, manifest.leaves.columns
    width = ARITY ** manifest.height
    parts = ("size", "height", "nodes", "upper")
    blocks = _block_uppers(manifest).select("grp", "block", "subroot", *parts)
    own = leaves.withColumn("block", F.floor(F.col("at") / width))
    both = own.unionByName(blocks, allowMissingColumns=True)
    dealt = both.repartition("grp", "block").sortWithinPartitions(
        "grp", "block", F.col("at").asc_nulls_first())
    schema = T.StructType([*leaves.schema.fields, T.StructField("subroot", T.BinaryType()),
                           T.StructField("proof", T.BinaryType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, subroot = [], None
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("size"))
            heads = np.flatnonzero(size.is_valid().to_numpy(zero_copy_only=False)).tolist()
            table = batch.select(names)
            begin = 0
            for head in [*heads, batch.num_rows]:
                part = table.slice(begin, head - begin)
                if part.num_rows:
                    first = part.column(part.schema.get_field_index("at")).to_numpy() % width
                    yield pa.RecordBatch.from_arrays([
                        *part.columns, pa.array([subroot] * part.num_rows, pa.binary()),
                        pa.array([paths[i] for i in first.tolist()], pa.binary()),
                    ], names=[*table.schema.names, "subroot", "proof"])
                if head < batch.num_rows:
                    b = batch.slice(head, 1).to_pylist()[0]
                    paths = leaf_paths(b["nodes"], b["size"], b["height"], b["upper"])
                    subroot = b["subroot"]
                begin = head + 1

    return dealt.mapInArrow(rows, schema)


def verify(proved: DataFrame, claim: str) -> DataFrame:
    """``proved`` without ``proof``, but with ``siblings`` (SHA-256 over the proof's digests) and
    ``folded`` (the root that ``claim``, a digest, leads to). Needs no manifest."""
    kept = [c for c in proved.columns if c != "proof"]
    schema = T.StructType([*[proved.schema[c] for c in kept],
                           T.StructField("siblings", T.BinaryType()),
                           T.StructField("folded", T.BinaryType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            claims, proofs = (batch.column(batch.schema.get_field_index(c)).to_pylist()
                              for c in (claim, "proof"))
            yield pa.RecordBatch.from_arrays([
                *[batch.column(batch.schema.get_field_index(c)) for c in kept],
                pa.array([sha256(siblings(p).encode()).digest() for p in proofs], pa.binary()),
                pa.array([folded(c, p) for c, p in zip(claims, proofs)], pa.binary()),
            ], names=schema.names)

    return proved.mapInArrow(rows, schema)

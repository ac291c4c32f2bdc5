"""Documents as token sequences of bounded length: large-item matching, then best fit.

Pieces above a third of the capacity meet at most once more in a sequence, so they are paired
greedily: the largest with the largest that still fits, which pairs as many as possible. Smaller
pieces, largest first, fill the smallest gap that takes them. Where a piece goes depends on its
length only, so the plan is made on counts by length: at most ``capacity`` rows, whatever the
corpus. Pieces are then sorted by length over the cluster, and each finds its place in the plan
from its position in that order.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.llm.scratch import stored
from facetlake.operators.numbering import global_positions

CAPACITY = 4096
END_ID = 1
# Words and their parts remembered by a Python worker; beyond that the memory starts anew.
WORDS_KEPT = 800_000
PARTS_KEPT = 800_000


@dataclass
class Plan:
    """Runs of equally long pieces, longest first: from place ``start`` on, ``per_bin`` pieces
    go into each sequence from ``sequence`` on, the first of them at ``offset``."""

    size: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    per_bin: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    n_sequences: int = 0

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.array(getattr(self, k), dtype=np.int64)
                for k in ("size", "start", "per_bin", "sequence", "offset")}


def plan_sequences(counts: Mapping[int, int], capacity: int = CAPACITY) -> Plan:
    """``counts``: pieces by length, each length from 1 to ``capacity``."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {size: [] for size in counts}
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens: ranges of sequences
    order: list[int] = []  # its keys, ascending
    used = 0

    def put(size: int, pieces: int, per_bin: int, sequence: int, offset: int) -> None:
        runs[size].append((pieces, per_bin, sequence, offset))

    def free(gap: int, sequence: int, bins: int) -> None:
        if gap and bins:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((sequence, bins))

    large = sorted(s for s in counts if 3 * s > capacity and counts[s])
    left = {s: counts[s] for s in large}
    while large:
        a = large[-1]
        at = bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else 0
        if b == a and left[a] == 1:
            b = large[at - 1] if at >= 1 else 0
        if not b:
            put(a, left[a], 1, used, 0)
            free(capacity - a, used, left[a])
            used += left[a]
            left[a] = 0
        elif b == a:
            bins = left[a] // 2
            put(a, 2 * bins, 2, used, 0)
            free(capacity - 2 * a, used, bins)
            used += bins
            left[a] -= 2 * bins
        else:
            bins = min(left[a], left[b])
            put(a, bins, 1, used, 0)
            put(b, bins, 1, used, a)
            free(capacity - a - b, used, bins)
            used += bins
            left[a] -= bins
            left[b] -= bins
            if not left[b]:
                large.remove(b)
        if not left[a]:
            large.remove(a)

    for size in sorted((s for s in counts if 3 * s <= capacity and counts[s]), reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(order, size)
            if at == len(order):
                per_bin = capacity // size
                bins = max(1, n // per_bin)
                free(capacity, used, bins)
                used += bins
                continue
            gap = order[at]
            sequence, bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            per_bin = min(gap // size, n)
            full = min(bins, n // per_bin)
            put(size, full * per_bin, per_bin, sequence, capacity - gap)
            n -= full * per_bin
            free(gap - per_bin * size, sequence, full)
            free(gap, sequence + full, bins - full)

    plan, place = Plan(n_sequences=used), 0
    for size in sorted(runs, reverse=True):
        for pieces, per_bin, sequence, offset in runs[size]:
            plan.size.append(size)
            plan.start.append(place)
            plan.per_bin.append(per_bin)
            plan.sequence.append(sequence)
            plan.offset.append(offset)
            place += pieces
    return plan


# Latin-1 letters, then marks that are neither quotes nor part of a special token: the tokenizer
# lower-cases the letters and cuts before the marks, whatever stands around.
_SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!#$%&*.,;:()?-]*)")


# Byte-level vocabularies write a byte as the character of its code, where that one is printed,
# and the others in order from code 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class _Words(dict):
    """Ids, as little-endian bytes, of words between ASCII blanks."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {"": b""}

    def _encode(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _encode_part(self, part: str) -> bytes:
        """A part that the tokenizer would neither change nor cut goes to its model at once."""
        written = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [token.id for token in self.model.tokenize(written)]).tobytes()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= PARTS_KEPT:
                self.parts = {"": b""}
            found = self.parts[part] = self._encode_part(part)
        return found

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        simple = _SIMPLE.fullmatch(text)
        if simple:
            ids = self._part(simple[1].lower()) + self._part(simple[2])
        else:
            ids = self._encode(text)
        if len(word) <= 64:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = ids
        return ids


_LOADED: dict[str, _Words] = {}


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def token_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    id_column: str = "doc_id", text: str = "text", with_ids: bool = False, rows: int = 512,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and ``ids``, little-endian bytes) of every
    document's tokens and its end token, cut where they exceed the capacity.

    The tokenizer must treat ASCII white space as a boundary that leaves nothing behind, as the
    ones with word ends do: then words are encoded apart and remembered.
    """
    schema = T.StructType([
        T.StructField(id_column, docs.schema[id_column].dataType),
        T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ])
    end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
    chosen = docs.select(
        docs[id_column].alias("k"),
        F.coalesce(docs[text], F.lit("")).cast("binary").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = _Words(path)
        known = _LOADED[path]
        for batch in _slices(batches, rows):
            keys, out = [], ([], [], [], [], [])
            texts = [t.split() for t in batch.column(1).to_pylist()]
            for row, words in enumerate(texts):
                ids = b"".join(map(known.__getitem__, words)) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    keys.append(row)
                    for column, value in zip(out, (piece, at // 4, len(part) // 4,
                                                   zlib.crc32(part), part)):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, kind) for c, kind in zip(out, kinds)][:5 if with_ids else 4]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, pa.int64())), *columns],
                names=schema.names)

    return chosen.mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (stored, with a column ``length`` of 1 to ``capacity``) with ``sequence_id``
    and ``offset``.

    Pieces of one length are interchangeable for the plan; they are told apart by all their
    columns, so that equal lengths spread over as many tasks as they need.
    """
    counts = {r["length"]: r["n"] for r in
              pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_sequences(counts, capacity)
    runs = plan.arrays()
    order = [F.col("length").desc(), *[F.col(c) for c in pieces.columns
                                       if c not in ("length", "ids")]]
    placed = global_positions(pieces, order, "place_")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(batch.num_columns - 1).to_numpy() - 1
            i = np.searchsorted(runs["start"], place, side="right") - 1
            rank, per_bin = place - runs["start"][i], runs["per_bin"][i]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(runs["sequence"][i] + rank // per_bin),
                 pa.array(runs["offset"][i] + rank % per_bin * runs["size"][i])],
                names=schema.names)

    return placed.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    id_column: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents with their places: ``id, piece, start, length, ids_crc32,
    sequence_id, offset`` (and ``ids``).

    Defined cases: null and empty texts are one piece with the end token alone; longer documents
    than the capacity are cut, no others; repeated rows are packed each; an empty table gives no
    rows. Reads only the two named columns.
    """
    pieces = stored(
        token_pieces(docs, path, capacity, end_id, id_column, text, with_ids), "packing-pieces")
    return pack_pieces(pieces, capacity)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` from pieces packed with their ids: at most ``capacity`` tokens each,
    so that the group of a sequence is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.expr(
            "aggregate(parts, cast('' as binary), (all, p) -> concat(all, p.ids))").alias("ids"))

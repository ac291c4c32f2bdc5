"""Fuzzy duplicates of lines by MinHash.

A line is lower-cased and its white space made single blanks. Its set holds the shingles of 12
characters at every position, or the whole line if it is shorter, so that text without blanks is
looked at as closely as words. Equal lines are one class by hash. The sorted hashes of a set give its
signature: the least one in each of 16 ranges. A band is the value of a filled range and of the
next filled one, so a line is in up to 16 overlapping bands: a pair at the similarity limit misses
all of them once in some thousands. Sets of up to 16 shingles fill too few ranges for that and
meet by the least quarter of their hashes instead, of which two similar sets must share one; so do
the sets up to 21 that can be similar to them. Candidates are confirmed on full sets, components
follow, and of each component the first line of the corpus stays.

Lines are split, made normal and joined by DataFrame functions; their shingles are hashed in numpy,
a batch of lines at a time: by regular expressions that alone exceeded the time allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.functions.paths import evaluate_once
from facetlake.llm.families import links_within
from facetlake.llm.scratch import small, stored
from facetlake.llm.shingles import mix
from facetlake.llm.stars import linked

PERCENT = 75
SHINGLE = 12
RANGE_BITS = 4
SMALL_SET = 16
# Characters hashed together; a longer line is hashed alone.
PIECE_CHARS = 1 << 17
# The keys of all bands take more than the lines: they are grouped in so many turns.
KEY_PARTS = 4
_BLANKS = r"[\x20\x09-\x0D]+"

_RANDOM = np.random.default_rng(1217)
_CHAR = _RANDOM.integers(0, 1 << 63, size=1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _HIGH, _LENGTH, _PAIR, _ALONE = (
    int(x) << 1 | 1 for x in _RANDOM.integers(0, 1 << 63, size=5, dtype=np.uint64))
_MASK = (1 << 64) - 1
_BASE &= _MASK


def normal_line(line: Column) -> Column:
    """Lower case, words apart by one blank; empty without words."""
    # Most lines have single blanks alone: looking for others costs less than replacing them.
    uneven = F.lit(False)
    for blanks in ("  ", "\t", "\n", "\x0b", "\x0c", "\r"):
        uneven = uneven | line.contains(blanks)
    return F.btrim(F.lower(F.when(uneven, F.regexp_replace(line, _BLANKS, " ")).otherwise(line)))


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2^bits powers of the base and of its inverse, modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([
        np.ones(1, dtype=np.uint64), np.full((1 << bits) - 1, x, dtype=np.uint64)]))
        for x in (_BASE, inverse))


def _sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all normal lines, one line after the other, and how
    many each has; from rolling sums over the lines laid end to end."""
    lengths = np.array([len(line) for line in lines], dtype=np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), dtype="<u4")
    powers, inverses = _powers(max(1, len(codes)).bit_length())
    values = _CHAR[codes & 0xFFFF]
    if len(codes) and codes.max() > 0xFFFF:
        values = values + (codes >> 16).astype(np.uint64) * np.uint64(_HIGH & _MASK)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(values * powers[:len(codes)], dtype=np.uint64, out=sums[1:])
    n = max(0, len(codes) - SHINGLE + 1)
    windows = mix((sums[SHINGLE:SHINGLE + n] - sums[:n]) * inverses[:n]).view(np.int64)

    sizes = np.maximum(lengths - SHINGLE + 1, 1)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.empty(offsets[-1], dtype=np.int64)
    short = np.flatnonzero(lengths < SHINGLE)
    whole = (sums[ends[short]] - sums[begins[short]]) * inverses[begins[short]]
    flat[offsets[short]] = mix(
        whole + lengths[short].astype(np.uint64) * np.uint64(_LENGTH & _MASK)).view(np.int64)
    for i in np.flatnonzero(lengths >= SHINGLE).tolist():
        part = flat[offsets[i]:offsets[i + 1]]
        part[:] = windows[begins[i]:begins[i] + len(part)]
        part.sort()
    fresh = np.ones(len(flat), dtype=bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[offsets[:-1]] = True
    before = np.concatenate([[0], np.cumsum(fresh)])
    return flat[fresh], np.diff(before[offsets])


def shingle_hashes(lines: list[str]) -> Iterator[np.ndarray]:
    """For each normal line the sorted distinct hashes of its shingles."""
    flat, counts = _sets(lines)
    yield from np.split(flat, np.cumsum(counts)[:-1])


def _keys(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands of sorted sets that lie one after the other, and how many each has; of
    a small set also the elements it must share one of."""
    starts = np.cumsum(counts) - counts
    small_ones = np.flatnonzero(counts <= SMALL_SET * 100 // PERCENT)
    n = counts[small_ones]
    head = n - -(-n * PERCENT // 100) + 1
    at = np.arange(head.sum()) + np.repeat(starts[small_ones] - (np.cumsum(head) - head), head)
    alone = mix(flat[at].view(np.uint64) ^ np.uint64(_ALONE & _MASK))

    ranges = flat >> (64 - RANGE_BITS)
    begins = np.ones(len(flat), dtype=bool)
    begins[1:] = ranges[1:] != ranges[:-1]
    begins[starts] = True
    at = np.flatnonzero(begins)
    owner = np.searchsorted(starts, at, side="right") - 1
    banded = counts[owner] > SMALL_SET
    at, owner = at[banded], owner[banded]
    filled = np.bincount(owner, minlength=len(counts))
    last = np.cumsum(filled)[filled > 0] - 1
    following = np.arange(1, len(at) + 1)
    following[last] = last + 1 - filled[filled > 0]
    least = flat[at].view(np.uint64)
    pairs = mix(least * np.uint64(_PAIR & _MASK) + least[following])

    owners = np.concatenate([np.repeat(small_ones, head), owner])
    keys = np.concatenate([alone, pairs]).view(np.int64)
    return (keys[np.argsort(owners, kind="stable")],
            np.bincount(owners, minlength=len(counts)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of the bands of a sorted set; of a small one the elements it must share one of."""
    return _keys(hashes, np.array([len(hashes)]))[0]


def _pieces(sizes: list[int]) -> Iterator[slice]:
    begin = held = 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > PIECE_CHARS:
            yield slice(begin, i)
            begin, held = i, 0
        held += size
    yield slice(begin, len(sizes))


def _sets_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``_sets`` in pieces of bounded text."""
    found = [_sets(lines[piece]) for piece in _pieces([len(line) for line in lines])]
    return np.concatenate([f for f, _ in found]), np.concatenate([c for _, c in found])


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with the size ``n`` of the set and the ``keys`` of its bands in place of the last
    column, a normal line."""
    schema = T.StructType([
        *rows.schema.fields[:-1], T.StructField("n", T.IntegerType()),
        T.StructField("keys", T.ArrayType(T.LongType()))])

    def lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(batch.num_columns - 1).to_pylist()
            for piece in _pieces([len(line) for line in lines]):
                flat, counts = _sets(lines[piece])
                found = [pa.array(counts, pa.int32()), lists(*_keys(flat, counts))]
                whole = batch.slice(piece.start, piece.stop - piece.start)
                yield pa.RecordBatch.from_arrays(
                    [*whole.columns[:-1], *found], names=schema.names)

    return rows.mapInArrow(run, schema)


def _similar(edges: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The ``(a, b)`` of ``edges`` whose lines, from ``texts`` (``id, s``), have full sets similar
    enough. Lines move, not their sets, which take many times the bytes."""
    left = texts.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = texts.select(F.col("id").alias("b"), F.col("s").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            for piece in _pieces([len(x) + len(y) for x, y in pairs]):
                flat, counts = _sets([line for pair in pairs[piece] for line in pair])
                total = counts[0::2] + counts[1::2]
                ends = np.cumsum(total)
                for begin, end in zip((ends - total).tolist(), ends.tolist()):
                    flat[begin:end].sort()
                twice = np.zeros(len(flat), dtype=bool)
                twice[1:] = flat[1:] == flat[:-1]
                twice[ends - total] = False
                seen = np.concatenate([[0], np.cumsum(twice)])
                both = seen[ends] - seen[ends - total]
                alike = pa.array(100 * both >= percent * (total - both))
                yield batch.slice(piece.start, len(total)).select([0, 1]).filter(alike)

    return edges.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(
        run, edges.select("a", "b").schema)


def _lines(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``id, t, line, s``: id (least possible if null), hash of the text, line number, line."""
    body = F.coalesce(docs[text], F.lit(""))
    return docs.select(
        docs[id_column].alias("id"), F.xxhash64(body).alias("t"),
        F.posexplode(F.split(body, "\n")).alias("line", "raw"),
    ).where(F.col("raw").rlike(r"[^\x20\x09-\x0D]")).select(
        "id", "t", "line", normal_line(F.col("raw")).alias("s"))


def _hash(line: Column) -> Column:
    return F.xxhash64(line)


def line_components(docs: DataFrame, id_column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """All lines (``id, t, line, h, g``, stored) and ``h, component`` of the linked ones.

    A line's node is its 64-bit hash ``h``; ``g`` is a second one. Lines that share ``h`` by
    chance, seen from ``g``, take no part.
    """
    split = _lines(docs, id_column, text).select(
        "id", "t", "line", _hash(F.col("s")).alias("h"), F.xxhash64("s", F.lit(1)).alias("g"), "s")
    lines = stored(_hashed(split), "lines")

    banded = lines.select("h", "n", F.explode("keys").alias("key"))
    parts = []
    for part in range(KEY_PARTS):
        some = banded.where(F.pmod("key", F.lit(KEY_PARTS)) == part)
        several = stored(some.groupBy("key").agg(
            F.min("h").alias("h0"), F.max("h").alias("h1")).where("h0 <> h1").select("key"),
            "line-buckets")
        parts.append(stored(some.join(small(several, 16), "key").select(
            "key", F.col("h").alias("id"), "n").distinct(), "line-shared"))
    shared = reduce(DataFrame.union, parts)
    nodes = stored(shared.select(F.col("id").alias("h")).distinct(), "line-nodes")
    texts = _lines(docs, id_column, text).select(_hash(F.col("s")).alias("h"), "s").join(
        small(nodes, 16), "h").dropDuplicates(["h"])
    texts = stored(texts.select(F.col("h").alias("id"), "s"), "line-texts")

    def may_link(a: str, b: str) -> Column:
        m, n = F.col(f"{a}.n"), F.col(f"{b}.n")
        return 100 * F.least(m, n) >= PERCENT * F.greatest(m, n)

    def unlike(a: str, b: str) -> Column:
        return F.abs(F.col(f"{a}.n") - F.col(f"{b}.n"))

    labels = linked(shared, texts, PERCENT, may_link, unlike, "line", _similar,
                    lambda rows: links_within(rows, texts, _sets_of, PERCENT))
    return lines, labels.select(F.col("node").alias("h"), "component")


def dropped_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, t, lines``: for each document with repeated lines their numbers, from 0."""
    lines, labels = line_components(docs, id_column, text)
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "t", "line")
    classes = lines.groupBy("h").agg(
        F.min(place).alias("place"), F.min("g").alias("g0"), F.max("g").alias("g1"),
        F.count(F.lit(1)).alias("times")).where("g0 = g1")
    # A line that occurs once and is linked with none repeats nothing.
    named = stored(classes.join(labels, "h", "left").where(
        "times > 1 or component is not null").select(
        "h", "place", F.coalesce("component", "h").alias("component")), "line-classes")
    first = named.groupBy("component").agg(F.min("place").alias("first"))
    firsts = stored(named.join(first, "component").select("h", "first"), "line-firsts")
    repeated = lines.join(firsts, "h").where(place != F.col("first"))
    return stored(repeated.groupBy("id", "t").agg(
        F.collect_set("line").alias("lines")), "line-dropped")


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated lines of ``text``; every row and column stays, and columns
    ``lines_before`` and ``lines_dropped`` follow (in place of any of these names).

    Defined cases: null texts stay null with 0 lines; lines without words stay; equal lines
    within one text count too; the first line by id, text hash and line number stays, null ids
    first; rows with equal id and text are one document; an empty table gives no rows.
    """
    dropped = dropped_lines(docs, id_column, text)
    size = dropped.agg(F.sum(F.size("lines") * 4 + 48)).first()[0] or 0
    side = dropped.select(F.col("id").alias("_gone_id"), F.col("t").alias("_gone_text"),
                          F.sort_array("lines").alias("_gone"))
    if size <= 16 << 20:
        side = F.broadcast(side)
    body = F.coalesce(docs[text], F.lit(""))
    joined = docs.join(
        side, docs[id_column].eqNullSafe(F.col("_gone_id"))
        & (F.xxhash64(body) == F.col("_gone_text")), "left")
    before = F.when(docs[text].isNull(), 0).otherwise(F.size(F.split(body, "\n")))

    def without(gone: Column) -> Column:
        # Sorted numbers beside each other: one pass over the text's lines.
        parts = F.split(docs[text], "\n")
        return evaluate_once(parts, lambda p: F.array_join(F.flatten(F.zip_with(
            F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(p))),
            lambda a, b: F.slice(p, a + 2, b - a - 1))), "\n"))

    rest = F.when(F.col("_gone").isNull(), docs[text]).otherwise(without(F.col("_gone")))
    added = ("lines_before", "lines_dropped")
    return joined.select(
        *[rest.alias(c) if c == text else docs[c] for c in docs.columns if c not in added],
        before.cast("long").alias(added[0]),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(added[1]))

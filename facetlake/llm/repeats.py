"""Repeated passages of bytes: blockwise suffix work guided by a difference cover.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier in the corpus.
Sorting all suffixes of the corpus at once is out of reach, so:

1. Suffixes at the positions of a difference cover (8 residues of 57) get names for their next 44
   bytes. For any two equal strings of 100 bytes there is an offset below 57 at which both
   starts meet the cover, so both hold an equally named sample there. Samples are compared one
   bucket of names at a time; a name that occurs once rules out every start it stands for.
2. Repeated samples are named anew by 156 bytes. One that occurred before settles the 57 starts
   from it at once: each of their strings lies within what occurred before. So all copies of a
   long passage but the first are settled by an eighth of their positions.
3. Only starts before a repeated sample that are not settled remain. They are sorted by their
   whole 100 bytes, again one bucket at a time, and all but the first of equal ones are marked.
   The first occurrence of a string is never settled, so it is among them.

Only equality matters, so suffixes are ordered by 64-bit names of their bytes (and the bucket, of
an independent name) instead of the bytes. Buckets are made in number from the corpus' bytes, so
that one always fits a task. Equal names within a batch are settled there, and only the first
travels: a passage found in a third of all documents sends one entry per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.llm.scratch import small, stored
from facetlake.llm.shingles import mix

LENGTH = 100
PERIOD = 57
# A perfect difference set: every residue modulo 57 is the difference of two members.
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
LONG = LENGTH + PERIOD - 1
BUCKET_ENTRIES = 2_500_000
LEAST_BUCKETS = 24
BATCH_ENTRIES = 2_000_000  # places whose names are emitted together
BATCH_BYTES = 24 << 20  # and the text that holds them
# Runs of starts are sent to every executor up to this; beyond it, texts are shuffled to them.
RUNS_BYTES = 64 << 20
_CHUNK = 1 << 18  # positions hashed at once

_C = np.random.default_rng(57).integers(0, 1 << 63, size=16, dtype=np.uint64) | np.uint64(1)
_ID = T.StructType([T.StructField("k", T.LongType()), T.StructField("h", T.LongType())])
_BUCKETED = T.StructType([T.StructField("bucket", T.IntegerType()),
                          T.StructField("entries", T.BinaryType())])
_PLACES = T.StructType([*_ID, T.StructField("places", T.BinaryType())])
_RUNS = T.StructType([*_ID, T.StructField("runs", T.BinaryType()),
                      T.StructField("n", T.LongType())])


# --- names of strings -------------------------------------------------------------------


def _stir(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * _C[0]


def _chunk_names(data: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent names for the ``length`` bytes from each of the first ``n`` positions."""
    size = n + length
    padded = np.zeros(size + 16, dtype=np.uint8)
    padded[:min(len(data), size)] = data[:size]
    words = np.empty(size, dtype=np.uint64)
    for k in range(8):
        m = len(range(k, size, 8))
        words[k::8] = padded[k:k + 8 * m].view("<u8")
    names, width = _stir(words * _C[1]), 8
    level = 2
    while 2 * width <= length:
        names = _stir(names[:-width] * _C[level] + names[width:])
        width, level = 2 * width, level + 1
    head, tail = names[:n], names[length - width:length - width + n]
    return mix(head * _C[12] + tail), mix(head * _C[13] + tail * _C[14])


def names_at(data: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Names at ascending ``places`` of a buffer; every string must end within it."""
    first, second = np.empty(len(places), np.uint64), np.empty(len(places), np.uint64)
    for at in range(0, len(data), _CHUNK):
        a, b = np.searchsorted(places, [at, at + _CHUNK])
        if a < b:
            n = min(_CHUNK, len(data) - at)
            x, y = _chunk_names(data[at:at + n + length], n, length)
            inside = places[a:b] - at
            first[a:b], second[a:b] = x[inside], y[inside]
    return first, second


def cover_places(n_bytes: int, length: int) -> np.ndarray:
    """Positions of the cover whose next ``length`` bytes exist."""
    rounds = np.arange(0, max(0, n_bytes - length + 1), PERIOD)
    places = (rounds[:, None] + np.array(COVER)).ravel()
    return places[places <= n_bytes - length]


# --- compact tables ---------------------------------------------------------------------


def pack_ascending(values: np.ndarray) -> bytes:
    """Differences of ascending numbers below 2^32, byte planes apart: they compress well."""
    steps = np.diff(values, prepend=0).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_ascending(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def _join(parts: list[bytes]) -> bytes:
    head = np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes()
    return head + b"".join(parts)


def _split(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ends = np.cumsum([8 * (n + 1), *np.frombuffer(data, "<i8", n, 8)])
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def runs_of(places: np.ndarray, reach: int = 0) -> np.ndarray:
    """Pairs (first, last) of the maximal runs of ascending ``places``, steps up to
    ``reach + 1`` apart counting as one run."""
    if not len(places):
        return np.zeros((0, 2), dtype=np.int64)
    breaks = np.flatnonzero(np.diff(places) > reach + 1)
    return np.stack([places[np.append(0, breaks + 1)], places[np.append(breaks, -1)]], axis=1)


# --- comparing entries bucket by bucket -------------------------------------------------


def _emit(
    ids: list[tuple[int, int]], sizes: list[int], places: np.ndarray,
    names: tuple[np.ndarray, np.ndarray], n_buckets: int, mark_first: bool, width: str,
) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, entries) of one batch. Equal names in one bucket leave one entry, their
    first; the places that are settled by that travel in the same bucket as a bare list. Where
    names of several buckets mix, an equal one may travel again, which only costs its entry."""
    bucket = (names[1] % np.uint64(n_buckets)).astype(np.uint32)
    order = np.argsort(names[0], kind="stable")
    ordered, dealt_to = names[0][order], bucket[order]
    new = np.append(True, (ordered[1:] != ordered[:-1]) | (dealt_to[1:] != dealt_to[:-1]))[
        :len(ordered)]
    repeated = ~(new & np.append(new[1:], True)[:len(new)])
    firsts = np.sort(order[new])
    settled = np.sort(order[repeated if mark_first else ~new])
    documents = [np.array([k for k, _ in ids], "<i8").tobytes(),
                 np.array([h for _, h in ids], "<i8").tobytes(),
                 pack_ascending(np.cumsum(sizes))]
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for chosen in (firsts, settled):
        dealt = chosen[np.argsort(bucket[chosen], kind="stable")]
        parts.append((dealt, np.searchsorted(bucket[dealt], np.arange(n_buckets + 1))))
    numbers, blobs = [], []
    for b in range(n_buckets):
        (one, cut1), (two, cut2) = parts
        x, y = one[cut1[b]:cut1[b + 1]], two[cut2[b]:cut2[b + 1]]
        if len(x) or len(y):
            numbers.append(b)
            blobs.append(_join([*documents, names[0][x].astype(width).tobytes(),
                                pack_ascending(places[x]), pack_ascending(places[y])]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=_BUCKETED.names)


def _by_document(
    k: np.ndarray, h: np.ndarray, ends: np.ndarray, places: np.ndarray
) -> tuple[list[int], list[int], list[bytes]]:
    """The places of one batch, apart by document and counted from its start."""
    owner = np.searchsorted(ends, places, side="right")
    inside = places - np.append(0, ends)[owner]
    docs, starts = np.unique(owner, return_index=True)
    cuts = np.append(starts, len(places))
    return (k[docs].tolist(), h[docs].tolist(),
            [pack_ascending(inside[a:b]) for a, b in zip(cuts, cuts[1:])])


def _compare(mark_first: bool, width: str) -> Callable[[pa.Table], pa.Table]:
    """For one bucket: the places whose name occurs again (``mark_first``) or occurred before."""
    def run(table: pa.Table) -> pa.Table:
        blobs = [_split(b) for b in table.column("entries").to_pylist()]
        k = [np.frombuffer(b[0], "<i8") for b in blobs]
        h = [np.frombuffer(b[1], "<i8") for b in blobs]
        ends = [unpack_ascending(b[2]) for b in blobs]
        names = [np.frombuffer(b[3], width) for b in blobs]
        places = [unpack_ascending(b[4]) for b in blobs]
        cuts = np.cumsum([0, *map(len, names)])
        every = np.concatenate(names)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        new = np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)]
        marked = np.zeros(len(every), dtype=bool)
        if mark_first:
            marked[order] = ~(new & np.append(new[1:], True)[:len(new)])
        else:
            # Places in the corpus' order: documents by key, laid end to end.
            keys, hashes = np.concatenate(k), np.concatenate(h)
            sizes = np.concatenate([np.diff(e, prepend=0) for e in ends])
            ranked = np.lexsort((hashes, keys))
            base = np.empty(len(ranked), dtype=np.int64)
            base[ranked] = np.cumsum(sizes[ranked]) - sizes[ranked]
            at = np.cumsum([0, *map(len, k)])
            where = np.concatenate([
                p - np.append(0, e)[o] + base[a + o]
                for p, e, a in zip(places, ends, at)
                for o in [np.searchsorted(e, p, side="right")]])[order]
            starts = np.flatnonzero(new)
            if len(starts):
                least = np.repeat(np.minimum.reduceat(where, starts),
                                  np.diff(np.append(starts, len(where))))
                marked[order] = where != least
        out: tuple[list, list, list] = ([], [], [])
        for i, blob in enumerate(blobs):
            mine = places[i][marked[cuts[i]:cuts[i + 1]]]
            mine = np.union1d(mine, unpack_ascending(blob[5]))
            for column, values in zip(out, _by_document(k[i], h[i], ends[i], mine)):
                column += values
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                         pa.array(out[2], pa.binary())], names=_PLACES.names)

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


Starts = Callable[[tuple], np.ndarray]


def _batched(
    rows: Iterator[tuple], starts: Starts
) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """Documents (k, h, bytes, ...) with their starts by the batch, in the corpus' order."""
    held, size, n = [], 0, 0
    for row in rows:
        places = starts(row)
        if not len(places):
            continue
        held.append((row, places))
        size, n = size + len(row[2]), n + len(places)
        if size >= BATCH_BYTES or n >= BATCH_ENTRIES:
            held.sort(key=lambda r: r[0][:2])
            yield [r for r, _ in held], [p for _, p in held]
            held, size, n = [], 0, 0
    if held:
        held.sort(key=lambda r: r[0][:2])
        yield [r for r, _ in held], [p for _, p in held]


def _bucketed(
    rows: DataFrame, starts: Starts, length: int, n_buckets: int, mark_first: bool, width: str
) -> DataFrame:
    """``bucket, entries``: the names of ``length`` bytes from each document's ``starts``.
    The first three columns of ``rows`` are ``k, h, b``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, found in _batched(_documents(batches), starts):
            sizes = [len(row[2]) for row in held]
            places = np.concatenate([p + at for p, at in zip(found, np.cumsum([0, *sizes]))])
            data = np.frombuffer(b"".join(row[2] for row in held), dtype=np.uint8)
            names = names_at(data, places, length)
            if width == "<u4":
                names = (names[0] >> np.uint64(32), names[1])
            yield from _emit([row[:2] for row in held], sizes, places, names, n_buckets,
                             mark_first, width)

    return rows.mapInArrow(run, _BUCKETED)


def _merged(parts: DataFrame, merge: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """``k, h, runs, n``: each document's third columns made into runs that hold ``n`` places. A
    document's own places are its group: bounded by its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [merge(lists).astype("<i8") for lists in batch.column(2).to_pylist()]
            sizes = [int((r[:, 1] - r[:, 0] + 1).sum()) for r in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([r.tobytes() for r in found], pa.binary()),
                 pa.array(sizes, pa.int64())], names=_RUNS.names)

    gathered = parts.groupBy("k", "h").agg(F.collect_list(parts.columns[2]).alias("parts"))
    return gathered.mapInArrow(run, _RUNS)


def _places(parts: list[bytes]) -> np.ndarray:
    return np.unique(np.concatenate([unpack_ascending(p) for p in parts]))


def _expand(runs: np.ndarray) -> np.ndarray:
    """The ascending places of runs, which may overlap."""
    return np.unique(np.concatenate([np.arange(a, b + 1) for a, b in runs] or [runs[:0, 0]]))


def _pairs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, 2)


def _sized(runs: DataFrame) -> DataFrame:
    """Stored ``runs``, marked for broadcast if their bytes fit the bound."""
    total = runs.agg(F.sum(F.length("runs") + 64)).first()[0] or 0
    return F.broadcast(runs) if total <= RUNS_BYTES else runs


# --- the operator -----------------------------------------------------------------------


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``k, h, b, g``: order key, text hashes and bytes. Documents are ordered by id, then hash;
    a null id comes first."""
    body = F.coalesce(docs[text], F.lit("")).cast("binary")
    key = F.coalesce(docs[id_column].cast("long"), F.lit(-(1 << 63)))
    return docs.select(key.alias("k"), F.xxhash64(body).alias("h"), body.alias("b"),
                       F.xxhash64(body, F.lit(1)).alias("g"), docs[id_column].alias("id"))


def repeated_runs(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The documents (``k, h, b, g, id, first``: the first copy's key) and ``k, h, runs``: for
    documents with repeats, runs of starts of strings that occurred before."""
    keyed = _keyed(docs, id_column, text)
    copied = stored(
        keyed.select("k", "h", "g", F.length("b").alias("n")).groupBy("h", "g", "n").agg(
            F.min("k").alias("first"), F.max("k").alias("last"))
        .where("first <> last").select("h", "g", "n", "first"), "repeats-copies")
    whole = keyed.withColumn("n", F.length("b")).join(
        small(copied, 48), ["h", "g", "n"], "left").select("k", "h", "b", "g", "id", "first")
    unique = whole.where("first IS NULL OR first = k").select("k", "h", "b")
    total = keyed.agg(F.sum(F.length("b"))).first()[0] or 0

    def buckets(entries: int) -> int:
        return max(LEAST_BUCKETS, -(-entries // BUCKET_ENTRIES))

    def compared(rows: DataFrame, starts: Starts, length: int, entries: int, first: bool,
                 width: str) -> DataFrame:
        return _bucketed(rows, starts, length, buckets(entries), first, width).groupBy(
            "bucket").applyInArrow(_compare(first, width), _PLACES)

    sample = LENGTH - PERIOD + 1
    shared = compared(unique, lambda row: cover_places(len(row[2]), sample), sample,
                      total * len(COVER) // PERIOD, True, "<u4")

    def before(parts: list[bytes]) -> np.ndarray:
        # Starts from which some repeated sample lies less than a period ahead.
        runs = runs_of(_places(parts), PERIOD - 1)
        runs[:, 0] = np.maximum(runs[:, 0] - PERIOD + 1, 0)
        return runs

    likely = stored(_merged(shared, before), "repeats-likely")
    starts_left = likely.agg(F.sum("n")).first()[0] or 0

    def samples(row: tuple) -> np.ndarray:
        cover, runs = cover_places(len(row[2]), LONG), _pairs(row[3])
        inside = np.searchsorted(runs[:, 0], cover, side="right") - 1
        return cover[(inside >= 0) & (cover <= runs[inside, 1])]

    rest = unique.join(_sized(likely), ["k", "h"]).select("k", "h", "b", "runs")
    long = compared(rest, samples, LONG, starts_left * len(COVER) // PERIOD, False, "<u8")
    settled = stored(_merged(long, lambda parts: runs_of(_expand(np.stack(
        [p := _places(parts), p + PERIOD - 1], axis=1)))), "repeats-settled")
    starts_left -= settled.agg(F.sum("n")).first()[0] or 0

    def starts(row: tuple) -> np.ndarray:
        known = _pairs(row[4]) if row[4] is not None else np.zeros((0, 2), dtype=np.int64)
        places = np.setdiff1d(_expand(_pairs(row[3])), _expand(known), assume_unique=True)
        return places[places <= len(row[2]) - LENGTH]

    both = stored(likely.join(settled.select("k", "h", F.col("runs").alias("known")), ["k", "h"], "left"),
                  "repeats-both")
    rest = unique.join(_sized(both), ["k", "h"]).select("k", "h", "b", "runs", "known")
    again = compared(rest, starts, LENGTH, max(0, starts_left), False, "<u8")
    found = _merged(again, lambda parts: runs_of(_places(parts))).union(settled)
    merged = _merged(found, lambda parts: runs_of(_expand(np.concatenate(
        [_pairs(p) for p in parts]))))
    return whole, stored(merged, "repeats-runs")


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept`` of every document; ``kept`` holds the remaining
    bytes, which may cut a character.

    Defined cases: null texts are empty; texts below 100 bytes stay whole; ids are whole numbers
    and a null one comes first; rows with equal id and text are one document, rows with equal id
    and other texts are ordered by text hash; an empty table gives no rows. Reads only the two
    named columns.
    """
    whole, runs = repeated_runs(docs, id_column, text)
    schema = T.StructType([
        T.StructField(id_column, docs.schema[id_column].dataType),
        *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
        T.StructField("kept", T.BinaryType())])
    joined = whole.join(_sized(runs), ["k", "h"], "left").select(
        "id", "b", "runs", F.coalesce(F.col("first") < F.col("k"), F.lit(False)).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for body, data, copy in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                spans = _removed(len(body), data, copy)
                at, kept = 0, []
                for a, b in spans:
                    kept.append(body[at:a])
                    at = b
                out.append((len(body), sum(b - a for a, b in spans), len(spans),
                            b"".join([*kept, body[at:]])))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]],
                 pa.array(columns[3], pa.binary())], names=schema.names)

    return joined.mapInArrow(run, schema)


def _removed(size: int, data: bytes | None, copy: bool) -> list[tuple[int, int]]:
    """Removed byte ranges of a document."""
    if copy:
        return [(0, size)] if size >= LENGTH else []
    if data is None:
        return []
    spans: list[tuple[int, int]] = []
    for a, b in _pairs(data).tolist():
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], b + LENGTH)
        else:
            spans.append((a, b + LENGTH))
    return spans



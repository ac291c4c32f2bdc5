"""Passages of benchmark items inside documents, by winnowing.

Of every window of ``WINDOW`` consecutive words the least hash of a run of ``GRAM`` words is kept
(the last one among equals) as a fingerprint. Which one that is depends on the window's words
alone, so a window shared by a document and an item has the same fingerprint at the same place in
both: no shared passage of ``WINDOW`` words or more can be missed. Fingerprints of documents that
pass a Bloom filter of the items' ones travel, with the words round them, to an exact join; a hit
is extended word by word to both sides and counts if the shared run fills a window. Items with
fewer words than a window are one window, looked for by the hash of the whole item.

Words are found and hashed in numpy, a batch of texts at a time; the joins, the extension and the
counts are DataFrame work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.llm.scratch import BROADCAST_BYTES, stored
from facetlake.llm.shingles import mix

WINDOW = 10
GRAM = 5
# Bytes of text looked at together; a longer text is one piece.
PIECE_BYTES = 1 << 20
BITS_PER_KEY = 32
# The filter never grows beyond 4 MiB. A larger benchmark fills it more densely, so that more
# fingerprints reach the exact join; the results stay the same.
MAX_BLOCKS = 1 << 19

_RANDOM = np.random.default_rng(31)
_ODD = (_RANDOM.integers(0, 1 << 63, size=256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BYTE = _RANDOM.integers(0, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Digits, lower-cased letters and everything beyond ASCII belong to words.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts, one after the other, with their hashes."""

    def __init__(self, texts: list[bytes]):
        self.data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
        inside = _IN_WORD[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        firsts = np.searchsorted(self.starts, np.concatenate([[0], text_ends]))
        self.first, self.counts = firsts[:-1], np.diff(firsts)
        self.hashes = self._hashes(inside)
        # How many words of the same text there are from each word on.
        self.left = np.repeat(firsts[1:], self.counts) - np.arange(len(self.starts))

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        lengths = self.ends - self.starts
        if not len(lengths):
            return np.zeros(0, dtype=np.uint64)
        begins = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(
            begins.astype(np.int32), lengths)
        powers = np.cumprod(np.full(int(lengths.max()), _STEP, dtype=np.uint64))
        weighted = _BYTE[self.data[inside]] * powers[place]
        return mix(np.add.reduceat(weighted, begins) + lengths.astype(np.uint64) * _ODD[255])

    def grams(self, width: int, salt: int) -> np.ndarray:
        """Hashes of all runs of ``width`` words, across texts too."""
        n = max(0, len(self.hashes) - width + 1)
        found = np.full(n, _ODD[128 + salt], dtype=np.uint64)
        for j in range(width):
            found += self.hashes[j:j + n] * _ODD[j]
        return mix(found)

    def winnowed(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the least run of each window inside one text."""
        hashes = self.grams(gram, 0)
        n = max(0, len(self.hashes) - window + 1)
        least, at = hashes[:n].copy(), np.arange(n)
        for j in range(1, window - gram + 1):
            later = hashes[j:j + n]
            lower = later <= least
            np.copyto(least, later, where=lower)
            at[lower] = np.flatnonzero(lower) + j
        at = at[self.left[:n] >= window]
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        return at, hashes[at]

    def context(self, first: int, end: int) -> str:
        """The words from ``first`` to before ``end``, apart by blanks."""
        return b" ".join(
            self.data[a:b].tobytes()
            for a, b in zip(self.starts[first:end].tolist(), self.ends[first:end].tolist())).decode()


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``PIECE_BYTES``, with the place of the first."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > PIECE_BYTES:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(text)
    if texts:
        yield begin, texts[begin:]


def _listed(hashes: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    masks = np.uint64(1) << (hashes >> np.uint64(58))
    masks |= np.uint64(1) << ((hashes >> np.uint64(52)) & np.uint64(63))
    masks |= np.uint64(1) << ((hashes >> np.uint64(46)) & np.uint64(63))
    return blocks[hashes & np.uint64(len(blocks) - 1)] & masks == masks


def _block_and_mask(n_blocks: int) -> tuple[Column, Column]:
    """What ``_listed`` computes, for the column ``hash``."""
    def bit(shift: int) -> Column:
        place = F.shiftrightunsigned("hash", shift).bitwiseAND(63).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    return (F.col("hash").bitwiseAND(n_blocks - 1),
            bit(58).bitwiseOR(bit(52)).bitwiseOR(bit(46)))


def _filter_blocks(prints: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``hash``: at most ``MAX_BLOCKS`` words of 64 bits, each
    combined on the executors."""
    wanted = max(1, -(-prints.count() * BITS_PER_KEY // 64))
    n_blocks = min(MAX_BLOCKS, 1 << (wanted - 1).bit_length())
    block, mask = _block_and_mask(n_blocks)
    rows = prints.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(
        F.expr("bit_or(mask)").alias("mask"))
    found = rows.toArrow()
    blocks = np.zeros(n_blocks, dtype=np.uint64)
    blocks[found["block"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return blocks


def _scan(rows: DataFrame, name: str, text: str, lengths: tuple[int, ...], blocks, window: int,
          gram: int) -> DataFrame:
    """One row per text (``key, name, n_words``) and one per fingerprint (``key, name, hash``,
    the place ``at`` of its first context word, ``context``, ``off``set in it, and the words a
    run ``need``s).

    ``blocks`` (a broadcast filter, or None for all) chooses fingerprints; ``lengths`` are the
    word counts below ``window`` to look for, or None to take whole short texts.
    """
    schema = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("name", rows.schema[name].dataType),
        T.StructField("n_words", T.LongType()), T.StructField("hash", T.LongType()),
        T.StructField("at", T.LongType()), T.StructField("context", T.StringType()),
        T.StructField("off", T.IntegerType()), T.StructField("need", T.IntegerType()),
    ])

    def fingerprints(words: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """(hash, first context word, end, fingerprint's word, need)"""
        wanted = blocks.value if blocks is not None else None
        at, hashes = words.winnowed(window, gram)
        if wanted is not None:
            keep = _listed(hashes, wanted)
            at, hashes = at[keep], hashes[keep]
        holder = np.searchsorted(words.first, at, side="right") - 1
        lows = np.maximum(at - (window - gram), words.first[holder])
        highs = np.minimum(at + window, words.first[holder] + words.counts[holder])
        need = [window] * len(at)
        yield from zip(hashes.view(np.int64).tolist(), lows.tolist(), highs.tolist(),
                       at.tolist(), need)
        for m in lengths if lengths is not None else range(1, window):
            hashes = words.grams(m, m)
            if lengths is None:
                at = words.first[words.counts == m]
            else:
                at = np.flatnonzero(_listed(hashes, wanted) & (words.left[:len(hashes)] >= m))
            yield from zip(hashes[at].view(np.int64).tolist(), at.tolist(), (at + m).tolist(),
                           at.tolist(), [m] * len(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(1).cast(pa.binary()).to_pylist()]
            names = batch.column(0)
            for begin, piece in _pieces(texts):
                words = Words(piece)
                keys = pa.array(range(seen, seen + len(piece)), pa.int64())
                seen += len(piece)
                own = names.slice(begin, len(piece))
                holes = [pa.nulls(len(piece), t) for t in
                         (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [keys, own, pa.array(words.counts, pa.int64()), *holes], names=schema.names)
                found = list(fingerprints(words))
                for i in range(0, len(found), 20_000):
                    part = found[i:i + 20_000]
                    holder = np.searchsorted(words.first, [f[1] for f in part], side="right") - 1
                    whose = pa.array(holder)
                    yield pa.RecordBatch.from_arrays([
                        keys.take(whose), own.take(whose), pa.nulls(len(part), pa.int64()),
                        pa.array([f[0] for f in part], pa.int64()),
                        pa.array([f[1] for f in part] - words.first[holder], pa.int64()),
                        pa.array([words.context(f[1], f[2]) for f in part], pa.string()),
                        pa.array([f[3] - f[1] for f in part], pa.int32()),
                        pa.array([f[4] for f in part], pa.int32()),
                    ], names=schema.names)

    return rows.select(rows[name], rows[text]).mapInArrow(run, schema)


def _extended(pairs: DataFrame) -> DataFrame:
    """``first, end``: the run of shared words round the fingerprint, by the document's words."""
    ours, theirs = F.split("context", " "), F.split("item_context", " ")
    low = -F.least("off", "item_off")
    high = F.least(F.size("ours") - F.col("off"), F.size("theirs") - F.col("item_off"))
    differ = F.filter(
        F.sequence(low, high - 1),
        lambda d: F.get("ours", F.col("off") + d) != F.get("theirs", F.col("item_off") + d))
    left = F.coalesce(F.array_max(F.filter("differ", lambda d: d < 0)) + 1, low)
    right = F.coalesce(F.array_min(F.filter("differ", lambda d: d >= 0)), high)
    found = pairs.withColumns({"ours": ours, "theirs": theirs}).withColumn("differ", differ)
    found = found.withColumns({"left": left, "right": right})
    start = F.col("at") + F.col("off")
    return found.where(F.col("right") - F.col("left") >= F.col("need")).select(
        "key", "name", "item", (start + F.col("left")).alias("first"),
        (start + F.col("right")).alias("end"))


def _scanned(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str,
             window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The scanned documents and the runs they share with items."""
    if not 1 <= gram <= window <= 64:
        raise ValueError("a window has at most 64 words, a fingerprint at most as many")
    spark = docs.sparkSession
    listed = stored(_scan(items, item_id, text, None, None, window, gram), "item-prints")
    # At most window - 1 rows.
    short = listed.where((F.col("n_words") > 0) & (F.col("n_words") < window))
    lengths = tuple(sorted(r[0] for r in short.select("n_words").distinct().collect()))
    prints = stored(
        listed.where("hash IS NOT NULL").select(
            "hash", "need", F.col("name").alias("item"), F.col("context").alias("item_context"),
            F.col("off").alias("item_off")).distinct(), "distinct-prints")
    blocks = spark.sparkContext.broadcast(_filter_blocks(prints.select("hash").distinct()))
    scanned = stored(_scan(docs, doc_id, text, lengths, blocks, window, gram), "document-prints")
    pairs = scanned.where("hash IS NOT NULL").select("key", "name", "hash", "at", "context", "off")
    width = prints.agg(F.sum(F.octet_length("item_context") + 100)).first()[0] or 0
    side = F.broadcast(prints) if width <= BROADCAST_BYTES else prints
    runs = _extended(pairs.join(side, "hash")).distinct()
    return scanned, stored(runs, "shared-runs")


def shared_passages(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
    text: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """``doc_id, item_id, first, end``: runs of document words (numbered from 0) shared with an
    item. Runs may overlap; their union is all that a window covers."""
    runs = _scanned(docs, items, doc_id, item_id, text, window, gram)[1]
    return runs.select(F.col("name").alias(doc_id), F.col("item").alias(item_id), "first", "end")


def judge_contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
    text: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, item_ids, contaminated`` of every document.

    ``n_hit`` counts the words inside any occurrence of a window of an item, ``item_ids`` the
    items with occurring windows as sorted strings. Items meet documents through fingerprints
    only; the items' side is broadcast below a checked size and shuffled beyond it, where
    adaptive execution splits a passage that very many documents hold.

    Defined cases: a null or empty text has no words and no hit; so has an empty benchmark;
    items without words occur nowhere; repeated items count once, by id; a null item id hits
    words but is in no list; repeated or null document ids are judged row by row. Only the named
    columns are read.
    """
    scanned, runs = _scanned(docs, items, doc_id, item_id, text, window, gram)
    before = Window.partitionBy("key").orderBy("first", "end").rowsBetween(
        Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("first", reached))
    hits = runs.select("key", "first", "end").distinct().withColumn("fresh", fresh)
    hits = hits.groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    named = runs.select("key", F.col("item").cast("string").alias("item")).distinct()
    named = named.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    rows = scanned.where("hash IS NULL").select("key", "name", "n_words")
    judged = rows.join(hits.join(named, "key"), "key", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return judged.select(
        F.col("name").alias(doc_id), "n_words", n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
        (n_hit > 0).alias("contaminated"))

"""Alignment of two tokenizers over a corpus: groups, links and how often ids are linked.

Each Arrow batch is worked on as flat columns: token lists are flattened with their parents'
indices, byte lengths become ends by cumulative sums within each document, and a full outer hash
join of both sides' ends by (document, end) gives one row per stretch between two ends. Such a
stretch lies in exactly one token of each side, so these rows are the links, and the ends known to
both sides close the groups. Links are counted per document by ``Table.group_by``; Spark merges
the counts over the corpus.

Texts are tokenized by chunks that the tokenizers treat apart (words with the blank before them),
which a worker remembers; the ids are those of the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.llm.scratch import stored

# Chunks remembered by a worker, per tokenizer; beyond that the memory starts anew.
CHUNKS_KEPT = 400_000
LONGEST_KEPT = 64
# Bytes of text aligned together; a longer text is aligned alone.
SLICE_BYTES = 1 << 19
# Pairs whose counts are broadcast (16 bytes each); the rarer ones are joined.
HOT_PAIRS = 1 << 20
# Pairs counted together in a task before they are handed on.
HELD_PAIRS = 1 << 20
# Bits of a key that hold an end inside a document.
_END_BITS = 36

# The byte-level pattern splits white space by what follows it. With blanks and line feeds only,
# these chunks end where its matches do; other white space sends the text there whole.
_BYTE_CHUNKS = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]")
_OTHER_SPACE = re.compile("[^\\S \\n]|[\u180e\u200b\ufeff]")
_LETTERS_AND_MARKS = re.compile(
    "( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
_PIECE_CHUNKS = re.compile(r" +[^ ]+| +")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the others for 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class _Chunks:
    """Ids of texts from the ids of their chunks, as little-endian 32-bit bytes."""

    def __init__(self, pattern: re.Pattern, encode: Callable[[list[str]], list[list[int]]]):
        self.pattern, self.encode = pattern, encode
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Chunks not seen before are encoded together, once."""
        chunks = [self.pattern.findall(t) for t in texts]
        if len(self.known) >= CHUNKS_KEPT:
            self.known.clear()
        known = self.known
        fresh = list(set().union(*chunks).difference(known))
        long = {}
        for chunk, ids in zip(fresh, self.encode(fresh)):
            (known if len(chunk) <= LONGEST_KEPT else long)[chunk] = array("i", ids).tobytes()
        if long:
            known = {**known, **long}
        return [b"".join(map(known.__getitem__, c)) for c in chunks]


class ByteTokens:
    """A byte-level BPE of the tokenizers library, special tokens' strings being plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        byte, vocab = _byte_of_char(), tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else (
                entry.encode())
        self._tokenizer, self._model = tokenizer, tokenizer.model
        self._written = {b: c for c, b in byte.items()}
        self._marks: dict[str, list[int]] = {}  # of up to four of 31 marks
        self._chunks = _Chunks(_BYTE_CHUNKS, lambda chunks: list(map(self._chunk, chunks)))
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        self._by_chunk = kind["normalizer"] is None and kind["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
            "use_regex": True}

    def _whole(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _part(self, part: str) -> list[int]:
        if part.isascii():
            written = part.replace(" ", self._written[32])
        else:
            written = part.encode().decode("latin-1").translate(self._written)
        return [token.id for token in self._model.tokenize(written)]

    def _chunk(self, chunk: str) -> list[int]:
        """Letters and then marks are two matches of the pattern: they go to the model at once."""
        simple = _LETTERS_AND_MARKS.fullmatch(chunk)
        if not simple:
            return self._whole(chunk)
        letters, marks = simple.groups()
        if not marks:
            return self._part(letters)
        if len(marks) > 4:
            return self._part(letters) + self._part(marks)
        found = self._marks.get(marks)
        if found is None:
            found = self._marks[marks] = self._part(marks)
        return self._part(letters) + found

    def ids(self, texts: list[str]) -> list[bytes]:
        whole = [not self._by_chunk or bool(_OTHER_SPACE.search(t)) for t in texts]
        cut = iter(self._chunks.ids([t for t, w in zip(texts, whole) if not w]))
        return [array("i", self._whole(t)).tobytes() if w else next(cut)
                for t, w in zip(texts, whole)]


class PieceTokens:
    """A sentencepiece model that puts a blank before the text; ``ids`` takes it with the blank."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else
                      p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        blank = [model.piece_to_id("\u2581")]

        def encode(chunks: list[str]) -> list[list[int]]:
            # The library returns nothing for an empty text, where a blank would stand.
            found = model.encode([c[1:] for c in chunks], num_threads=1) if chunks else []
            return [ids if len(c) > 1 else blank[:len(c)] for c, ids in zip(chunks, found)]

        self._encode, self._chunks = encode, _Chunks(_PIECE_CHUNKS, encode)
        # No piece goes on after a blank, so no merge does.
        self._by_chunk = not any("\u2581" in p.lstrip("\u2581") for p in pieces)

    def ids(self, texts: list[str]) -> list[bytes]:
        whole = [not self._by_chunk or "\u2581" in t for t in texts]
        cut = iter(self._chunks.ids([t for t, w in zip(texts, whole) if not w]))
        return [array("i", self._encode([t])[0]).tobytes() if w else next(cut)
                for t, w in zip(texts, whole)]


class Sides:
    """Both tokenizers with the tables that go by their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        self.tokens = ByteTokens(byte_path), PieceTokens(piece_path)
        self.entries = [pa.array(t.bytes, pa.large_binary()) for t in self.tokens]
        self.lengths = [pc.binary_length(e).cast(pa.int64()) for e in self.entries]
        self.n_b = len(self.tokens[1].bytes)
        self.n_ids = max(len(t.bytes) for t in self.tokens)
        # An id with what follows it: "," inside a run, "|" between the sides, ";" after a group.
        self.texts = pa.array(
            [f"{i}{c}" for c in ",|;" for i in range(self.n_ids)], pa.large_string())

    def _lists(self, texts: list[str | None]) -> list[pa.LargeListArray]:
        """Both sides' ids; empty where either side's bytes are not the text's."""
        spaced = [" " + t if t else "" for t in texts]
        wanted = [t.encode() for t in spaced]
        found = []
        for tokens, entries in zip(self.tokens, self.entries):
            raw = tokens.ids(spaced)
            sizes = [len(r) // 4 for r in raw]
            flat = pa.array(np.frombuffer(b"".join(raw), dtype="<i4"))
            found.append(pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), flat))
        same = np.ones(len(texts), dtype=bool)
        for lists, entries in zip(found, self.entries):
            joined = entries.take(lists.values)
            ends = np.frombuffer(joined.buffers()[1], dtype=np.int64)[
                joined.offset + lists.offsets.to_numpy()]
            data = memoryview(joined.buffers()[2] or b"")
            same &= np.array([data[a:b].tobytes() == w for a, b, w in zip(ends[:-1], ends[1:], wanted)],
                             dtype=bool)
        if not same.all():
            none = pa.scalar([], pa.large_list(pa.int32()))
            found = [pc.if_else(pa.array(same), x, none) for x in found]
        return found

    def _ends(self, lists: pa.LargeListArray, side: int) -> tuple[pa.Array, pa.Array]:
        """Ids of all tokens, and (document, end) of each as one number."""
        ids, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
        if not len(ids):
            return ids, pa.array([], pa.int64())
        total = pc.cumulative_sum(self.lengths[side].take(ids)).to_numpy()
        parent = parents.to_numpy()
        first = np.searchsorted(parent, parent)
        before = np.where(first > 0, total[first - 1], 0)
        return ids, pa.array((parent << _END_BITS) + total - before)

    def align(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """Columns of one row per text: n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts.

        A pair of ids is one number, ``a * n_b + b``; ``pairs`` lists those linked in the text,
        ``counts`` how many links hold each.
        """
        n = len(texts)
        lists = self._lists(texts)
        ids, ends, sizes = [], [], []
        for side in (0, 1):
            flat, at = self._ends(lists[side], side)
            ids.append(flat.to_numpy())
            ends.append(at)
            sizes.append(pc.list_value_length(lists[side]).to_numpy())
        tables = [pa.table({"end": e, name: pa.array(np.arange(len(e)))})
                  for e, name in zip(ends, "ab")]
        rows = tables[0].join(tables[1], keys="end", join_type="full outer", use_threads=False)
        end = rows["end"].to_numpy()
        order = pa.array(np.argsort(end, kind="stable"))
        end = end[order]
        at = [rows[name].combine_chunks().take(order) for name in "ab"]
        own = [a.is_valid().to_numpy(zero_copy_only=False) for a in at]
        both = own[0] & own[1]
        parent = end >> _END_BITS
        token = [pc.fill_null_backward(a).to_numpy() for a in at]
        pair = ids[0].astype(np.int64)[token[0]] * self.n_b + ids[1][token[1]]

        linked = pa.table({"doc": parent, "pair": pair}).group_by(
            ["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        doc = linked["doc"].to_numpy()
        by_doc = pa.array(np.argsort(doc, kind="stable"))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
        pairs, counts = (pa.ListArray.from_arrays(
            offsets, linked[c].combine_chunks().take(by_doc).cast(pa.int64()))
            for c in ("pair", "count_all"))
        return {
            "n_a": pa.array(sizes[0], pa.int64()), "n_b": pa.array(sizes[1], pa.int64()),
            "n_groups": pa.array(np.bincount(parent[both], minlength=n), pa.int64()),
            "n_links": pa.array(np.bincount(parent, minlength=n), pa.int64()),
            "groups_sha256": pa.array(self._digests(ids, own, both, sizes), pa.string()),
            "pairs": pairs, "counts": counts,
        }

    def _digests(self, ids, own, both, sizes) -> list[str]:
        """SHA-256 of each text's groups; empty where it has no tokens."""
        # The group of a stretch is the number of groups closed before it.
        group = np.cumsum(both) - both
        n_groups = int(both.sum())
        mine = [group[o] for o in own]
        inside = [np.cumsum(np.bincount(g, minlength=n_groups)) for g in mine]
        places = (np.arange(len(mine[0])) + np.concatenate([[0], inside[1]])[mine[0]],
                  np.arange(len(mine[1])) + inside[0][mine[1]])
        codes = np.empty(len(mine[0]) + len(mine[1]), dtype=np.int64)
        for side in (0, 1):
            last = np.append(mine[side][1:] != mine[side][:-1], True)[:len(mine[side])]
            codes[places[side]] = ids[side] + self.n_ids * (side + 1) * last
        texts = self.texts.take(pa.array(codes))
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64) if len(codes) else np.zeros(1)
        cuts = offsets[np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])])].astype(int).tolist()
        data = memoryview(texts.buffers()[2] or b"")
        # The mark after the last group is left out.
        return [hashlib.sha256(data[a:b - 1]).hexdigest() if b > a else ""
                for a, b in zip(cuts, cuts[1:])]


_LOADED: dict[tuple[str, str], Sides] = {}


def loaded(byte_path: str, piece_path: str) -> Sides:
    key = (byte_path, piece_path)
    if key not in _LOADED:
        _LOADED[key] = Sides(*key)
    return _LOADED[key]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Consecutive rows with about ``SLICE_BYTES`` of text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    begin = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and held + size > SLICE_BYTES:
            yield begin, i
            begin, held = i, 0
        held += size
    if len(sizes):
        yield begin, len(sizes)


def align_texts(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``row, key`` and the columns of ``Sides.align`` for every document; to be stored, which
    fixes the row numbers."""
    counted = ("n_a", "n_b", "n_groups", "n_links")
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("key", docs.schema[key].dataType),
        *[T.StructField(c, T.LongType()) for c in counted],
        T.StructField("groups_sha256", T.StringType()),
        *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "counts")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, row = loaded(byte_path, piece_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1)
            for a, b in _slices(texts):
                found = sides.align(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + b - a)), batch.column(0).slice(a, b - a),
                     *found.values()], names=schema.names)
                row += b - a

    return docs.select(docs[key], docs[text]).mapInArrow(run, schema)


def _counted(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate(
        [("n", "sum")]).select(["pair", "n_sum"]).rename_columns(["pair", "n"])


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """``pair, n, best``: the links of each pair of ids in the corpus, and whether no other pair
    with its B id has more."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            flat = [pc.list_flatten(batch.column(i)) for i in (0, 1)]
            held.append(pa.table(flat, names=["pair", "n"]))
            size += len(flat[0])
            if size >= 4 * HELD_PAIRS:
                held = [_counted(held)]
                size = held[0].num_rows
                if size >= HELD_PAIRS:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from _counted(held).to_batches()

    sums = aligned.select("pairs", "counts").mapInArrow(partial, "pair long, n long")
    counts = stored(sums.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b = F.col("pair") % n_b
    # One row per id of the B vocabulary at most.
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return stored(counts.join(F.broadcast(most), b == F.col("b")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def _frequent(pairs: DataFrame, at_most: int) -> tuple[int, DataFrame]:
    """The least power of two that at most ``at_most`` pairs reach, and those pairs."""
    level = F.floor(F.log2("n")).cast("int")
    # A row per power of two.
    sizes = dict(pairs.groupBy(level.alias("level")).count().collect())
    least = total = 0
    for power in sorted(sizes, reverse=True):
        total += sizes[power]
        if total > at_most:
            least = power + 1
            break
    return least, pairs.where(level >= least)


def align_tokenizers(
    docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text",
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document.

    A is the byte-level tokenizer on a blank and the text, B the piece tokenizer on the text.
    Counts of the most frequent pairs are broadcast (at most ``hot_pairs``); the pairs of a
    document beyond those are joined with their counts over the cluster. Those are the rare ones,
    so no key of that join is hot.

    Defined cases: a null or empty text, and one whose tokens' bytes are not the blank and the
    text, has no tokens: zeros and an empty digest; repeated rows and ids are kept and counted
    each; an empty table gives no rows. Only the named columns are read. Memory follows the
    longest text.
    """
    spark = docs.sparkSession
    n_b = len(PieceTokens(piece_path).bytes)
    aligned = stored(align_texts(docs, byte_path, piece_path, key, text), "aligned")
    pairs = pair_counts(aligned, n_b)
    least, frequent = _frequent(pairs, hot_pairs)
    hot = frequent.toArrow()
    known = spark.sparkContext.broadcast(tuple(hot[c].to_numpy() for c in ("pair", "n", "best")))
    schema = T.StructType([
        *[f for f in aligned.schema.fields if f.name not in ("pairs", "counts")],
        T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
        *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "counts")]])
    names = [f.name for f in schema.fields[:-4]]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = known.value
        codes, n, best = pa.array(codes), np.append(n, 0), np.append(best, False)
        for whole in batches:
            lists = whole.column(whole.schema.get_field_index("pairs"))
            sizes = np.cumsum(pc.list_value_length(lists).to_numpy())
            begin = 0
            while begin < whole.num_rows:
                done = int(sizes[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, done + HELD_PAIRS, "right")))
                yield one(whole.slice(begin, end - begin), codes, n, best)
                begin = end

    def one(batch: pa.RecordBatch, codes, n, best) -> pa.RecordBatch:
        lists = batch.column(batch.schema.get_field_index("pairs"))
        pair, times = (pc.list_flatten(batch.column(batch.schema.get_field_index(c)))
                       for c in ("pairs", "counts"))
        row, times = pc.list_parent_indices(lists).to_numpy(), times.to_numpy()
        at = pc.fill_null(pc.index_in(pair, value_set=codes), len(codes)).to_numpy()
        size = batch.num_rows
        sums = [np.zeros(size, dtype=np.int64) for _ in range(2)]
        np.add.at(sums[0], row, times * best[at])
        np.add.at(sums[1], row, times * n[at])
        rare = at == len(codes)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[rare], minlength=size))])
        rest = [pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(x[rare], pa.int64()))
                for x in (pair.to_numpy(), times)]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(batch.schema.get_field_index(c)) for c in names],
             *map(pa.array, sums), *rest], names=schema.names)

    found = aligned.mapInArrow(looked_up, schema)
    if least > 0:
        found = stored(found, "aligned-frequent")
        rare = found.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
        rare = rare.select("row", "p.pairs", "p.counts").join(
            pairs.withColumnRenamed("pair", "pairs"), "pairs")
        rare = rare.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("counts")).otherwise(0)).alias("more_best"),
            F.sum(F.col("counts") * F.col("n")).alias("more_sum"))
        found = found.join(rare, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return found.select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        "groups_sha256")

"""Byte-level byte-pair encoding and decoding in linear time.

A pre-split piece is a string of bytes, mapped to Latin-1 so that an Aho-Corasick automaton over
the vocabulary finds the longest token at every position in one pass. Encoding goes from left to
right by longest tokens. A token may follow another only if merging the bytes of the two would
give just these two; that answer is memoised per pair. Where no token fits, the last one is
taken back and its next shorter prefix is tried; a position from which nothing fits is marked, so
that it is never tried again. The outcome is the one that merging by rank gives.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Words and pieces remembered by a Python worker: at most twice as many, for what is in use is
# taken over when the older half is dropped. Of pairs the memory starts anew beyond the number.
WORDS_KEPT = 250_000
PIECES_KEPT = 150_000
PAIRS_KEPT = 500_000


def load_ranks(path: str) -> list[bytes]:
    """Tokens by id from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Vocabulary:
    """Decoder for one vocabulary."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.buffer = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.sizes = np.array([len(token) for token in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens, copied from one buffer that holds the vocabulary."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.buffer[np.arange(len(shift)) + shift].tobytes()


class BytePairs(Vocabulary):
    """Encoder and decoder for one vocabulary whose ids are the ranks of its merges."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        super().__init__(tokens)
        self.tokens = tokens
        self.ids = {token: i for i, token in enumerate(tokens) if token}
        self.split = regex.compile(pattern).findall
        self.lengths = [len(token) for token in tokens]
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.shorter = [self._longest_prefix(token) for token in tokens]
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(tokens))]
        self.merged: dict[tuple[int, int], int] = {}
        # By rank: the halves of a token are made by earlier merges.
        for i, token in enumerate(tokens):
            if len(token) > 1 and (halves := self._halves(token, i)):
                self.parts[i] = halves
                self.merged[halves] = i
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.older_pieces: dict[str, list[int]] = {}
        self.words = _Words(self)

    def _longest_prefix(self, token: bytes) -> int:
        return next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1)
                     if token[:n] in self.ids), -1)

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that the merge of this rank joins."""
        parts = [self.ids[token[i:i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            ranked = [(self.ids.get(self.tokens[a] + self.tokens[b], rank), k)
                      for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, k = min(ranked)
            if best >= rank:
                return None
            parts[k:k + 2] = [best]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of the two tokens leaves a boundary between them.

        Merges are undone along the boundary, latest first; a merge across it that would have
        come before the one undone last means that the two tokens are never neighbours.
        """
        if len(self.compatible) >= PAIRS_KEPT:
            self.compatible.clear()
        a, b, limit, answer = left, right, len(self.tokens) + 1, None
        while answer is None:
            across = self.merged.get((a, b))
            if across is not None and across < limit:
                answer = False
            elif a > b:
                inner = self.parts[a][1]
                if inner != a:
                    limit, a = a, inner
                elif self.parts[b][0] != b:
                    limit, b = b + 1, self.parts[b][0]
                else:
                    answer = True
            elif self.parts[b][0] != b:
                limit, b = b + 1, self.parts[b][0]
            elif self.parts[a][1] != a:
                limit, a = a, self.parts[a][1]
            else:
                answer = True
        self.compatible[left, right] = answer
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-split piece."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        longest = [-1] * len(piece)
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token  # ends ascend: the longest comes last
        sizes, shorter, known = self.lengths, self.shorter, self.compatible
        size = len(piece)
        dead = bytearray(size + 1)
        chosen: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            end = at + sizes[token]
            if not dead[end]:
                fits = last < 0 or known.get((last, token))
                if fits is None:
                    fits = self._fits(last, token)
                if fits:
                    chosen.append(token)
                    if end == size:
                        return chosen
                    at, last, token = end, token, longest[end]
                    continue
            token = shorter[token]
            if token < 0:
                dead[at] = 1
                token = shorter[chosen.pop()]
                at -= sizes[last]
                last = chosen[-1] if chosen else -1
                # The token taken back has no shorter prefix either: go on taking back.
                while token < 0:
                    dead[at] = 1
                    token = shorter[chosen.pop()]
                    at -= sizes[last]
                    last = chosen[-1] if chosen else -1

    def encode_pieces(self, text: str) -> list[int]:
        """Ids of a text cut by the pattern; equal pieces are encoded once while remembered."""
        known, ids = self.pieces, []
        for piece in self.split(text):
            found = known.get(piece)
            if found is None:
                if len(known) >= PIECES_KEPT:
                    self.older_pieces, self.pieces = known, {}
                    known = self.pieces
                found = self.older_pieces.get(piece)
                if found is None:
                    found = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= 64:
                    known[piece] = found
            ids += found
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, as 32-bit integers.

        No piece holds a blank between two other characters except as its first one, and a line
        end between two others is a piece. So a text may be cut before these, and the ids of
        equal words are joined from memory. Texts with runs of white space are cut by the pattern
        as they are.
        """
        first, *words = text.replace("\n", " \n").split(" ")
        try:
            if words and (not first or first[-1].isspace()):
                raise _UnevenBlanks
            rest = b"".join(map(self.words.__getitem__, words))
        except _UnevenBlanks:
            return np.array(self.encode_pieces(text), dtype=np.int32)
        start = np.array(self.encode_pieces(first), dtype=np.int32)
        return np.concatenate([start, np.frombuffer(rest, dtype=np.int32)])


class _UnevenBlanks(Exception):
    """The text has white space beside a blank."""


class _Words(dict):
    """Ids, as bytes, of a blank followed by the key; of the key if it starts with a line end."""

    def __init__(self, coder: BytePairs) -> None:
        super().__init__()
        self.coder = coder
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            inner = word.removeprefix("\n")
            if not inner or inner[0].isspace() or inner[-1].isspace():
                raise _UnevenBlanks
            cut = word if len(inner) < len(word) else " " + word
            ids = np.array(self.coder.encode_pieces(cut), dtype=np.int32).tobytes()
        if len(self) >= WORDS_KEPT:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


_LOADED: dict[tuple[str, str], BytePairs] = {}
_DECODERS: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The bytes of the tokens alone, once per Python worker."""
    if path not in _DECODERS:
        _DECODERS[path] = Vocabulary(load_ranks(path))
    return _DECODERS[path]


def byte_pairs(path: str, pattern: str) -> BytePairs:
    """The vocabulary, built once per Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = BytePairs(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",),
    text: str = "text", rows: int = 512,
) -> DataFrame:
    """``keep`` and ``ids`` (array of int) of every row; no shuffle, rows stay where they are.

    ``path`` names the rank file on every executor. Special tokens are ordinary text.
    Defined cases: null and empty texts have no ids; a text of any length is encoded whole;
    repeated rows each get their ids. Columns in ``keep`` may have any name but ``ids``.
    """
    chosen = docs.select(*[docs[k] for k in keep], docs[text].alias("ids"))
    schema = T.StructType([docs.schema[k] for k in keep] + [
        T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path, pattern)
        for batch in _slices(batches, rows):
            found = [coder.encode(t or "") for t in batch.column(len(keep)).to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(ends), pa.array(np.concatenate(found) if found else [], pa.int32()),
                type=pa.list_(pa.field("element", pa.int32(), nullable=False)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], lists], names=[*keep, "ids"])

    return chosen.mapInArrow(run, schema)


def decode_documents(
    encoded: DataFrame, path: str, pattern: str, ids: str = "ids", rows: int = 512
) -> DataFrame:
    """``encoded`` with the decoded bytes in a column ``decoded``; null ids give no bytes.

    Decoding needs no ``pattern``: it stands beside ``path`` as in ``encode_documents``."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    place = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        for batch in _slices(batches, rows):
            lists = batch.column(place)
            found = [coder.decode(lists[i].values.to_numpy()) if lists[i].is_valid else b""
                     for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, type=pa.binary())],
                names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)

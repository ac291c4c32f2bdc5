"""Byte-level BPE and packing against the libraries."""

import base64
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from facetlake.llm import bpe
from facetlake.llm.bpe import byte_pairs, decode_documents, encode_documents
from facetlake.llm.packing import (pack_documents, packed_sequences, plan_sequences, token_pieces)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_pairs(RANKS, PATTERN)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(
    st.text(max_size=80), st.text(alphabet="ab' \n\tst09é \x1c.", max_size=200),
    st.text(alphabet="aA", max_size=300)))
def test_same_ids_as_the_library(coder, library, text):
    ids = coder.encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_long_pieces_take_linear_time(coder):
    text = "ab" * 200_000 + " " * 100_000
    assert coder.decode(coder.encode(text)) == text.encode()


def test_code_points_fall_into_the_same_classes(coder, library):
    for start in range(0, 0x3000, 64):
        text = "".join(f"x{chr(c)}1{chr(c)}{chr(c)} " for c in range(start, start + 64))
        assert coder.encode(text).tolist() == library.encode_ordinary(text)


def test_documents_encoded_and_decoded(odd_docs, no_docs, library):
    encoded = encode_documents(odd_docs, RANKS, PATTERN, keep=("doc_id", "text", "key"))
    rows = decode_documents(encoded, RANKS, PATTERN).collect()
    assert len(rows) == odd_docs.count()
    for row in rows:
        assert row["ids"] == library.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode() and row["key"] == 7
    assert decode_documents(encode_documents(no_docs, RANKS, PATTERN), RANKS, PATTERN).count() == 0


def test_memory_of_words_and_pieces_is_bounded_and_changes_no_ids(coder, monkeypatch):
    """What is remembered is dropped by halves; words in use stay, and no id depends on it."""
    monkeypatch.setattr(bpe, "WORDS_KEPT", 8)
    monkeypatch.setattr(bpe, "PIECES_KEPT", 8)
    small = bpe.BytePairs(coder.tokens, PATTERN)
    texts = [f"a common word {n} other{n}, and\nline{n * 7919}" for n in range(60)]
    for text in texts:
        assert small.encode(text).tolist() == coder.encode(text).tolist()
        assert len(small.words) + len(small.words.older) <= 16
        assert len(small.pieces) + len(small.older_pieces) <= 16
    assert bpe.vocabulary(RANKS).decode(small.encode(texts[7])) == texts[7].encode()



# --- packing ----------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(data=st.data(), capacity=st.sampled_from([3, 10, 64]))
def test_plans_fill_sequences_without_gaps(data, capacity):
    sizes = data.draw(st.lists(st.integers(1, capacity), max_size=80))
    plan = plan_sequences(Counter(sizes), capacity)
    arrays, bins = plan.arrays(), {}
    for place, size in enumerate(sorted(sizes, reverse=True)):
        i = int(np.searchsorted(arrays["start"], place, side="right")) - 1
        rank = place - plan.start[i]
        assert plan.size[i] == size
        at = plan.offset[i] + rank % plan.per_bin[i] * size
        bins.setdefault(plan.sequence[i] + rank // plan.per_bin[i], []).append((at, size))
    for members in bins.values():
        end = 0
        for at, size in sorted(members):
            assert at == end
            end += size
        assert end <= capacity
    assert len(bins) == plan.n_sequences
    assert len(bins) <= max(1, 1.34 * -(-sum(sizes) // capacity) + len(bins) * (
        sum(2 * s > capacity for s in sizes) > 0))


def test_large_pieces_are_paired_as_often_as_possible():
    # 60 + 40, 55 + 45, 50 + 50: three sequences, where first fit in order needs four.
    assert plan_sequences(Counter([60, 55, 50, 50, 45, 40]), 100).n_sequences == 3


def test_pieces_equal_the_library(odd_docs):
    tokenizer = Tokenizer.from_file(WORDS)
    wanted = []
    for row in odd_docs.collect():
        ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids + [1]
        data = np.array(ids, dtype="<u4").tobytes()
        for piece, at in enumerate(range(0, len(data), 4 * 256)):
            part = data[at:at + 4 * 256]
            wanted.append((str(row["doc_id"]), piece, at // 4, len(part) // 4, zlib.crc32(part)))
    found = token_pieces(odd_docs, WORDS, capacity=256).collect()
    assert sorted((str(r["doc_id"]), *r[1:]) for r in found) == sorted(wanted)


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.one_of(
    st.characters(codec="utf-8"), st.sampled_from(" \ńΣİß'.,!<|> ")),
    max_size=60))
def test_words_apart_are_the_text(text):
    from facetlake.llm.packing import _Words
    words = _WORDS.setdefault("w", _Words(WORDS))
    ids = np.frombuffer(b"".join(words[w] for w in text.encode().split()), dtype="<u4")
    assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


_WORDS = {}


def test_packed_sequences_hold_every_token_once(odd_docs, no_docs):
    packed = pack_documents(odd_docs, WORDS, capacity=256, with_ids=True)
    rows = packed.collect()
    sequences = {r["sequence_id"]: bytes(r["ids"]) for r in packed_sequences(packed).collect()}
    assert all(len(s) <= 4 * 256 for s in sequences.values())
    for r in rows:
        part = sequences[r["sequence_id"]][4 * r["offset"]:4 * (r["offset"] + r["length"])]
        assert zlib.crc32(part) == r["ids_crc32"]
    assert sum(map(len, sequences.values())) == 4 * sum(r["length"] for r in rows)
    assert pack_documents(no_docs, WORDS).count() == 0

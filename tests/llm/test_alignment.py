"""Two tokenizers aligned, against the libraries on whole texts and a plain alignment."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from facetlake.llm.alignment import Sides, align_tokenizers
from tests.llm import plain

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    return Sides(A, B)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


TEXTS = st.one_of(
    st.text(min_size=1, max_size=60),
    st.text(alphabet="ab' \n\tst09é .,' 　\x1c▁", min_size=1, max_size=120),
    st.text(alphabet="aB \n", min_size=1, max_size=200),
    st.text(alphabet="aésÜ×÷ªµ'`.,~[\\]^_!%-& ", min_size=1, max_size=80))


def ids_of(raw):
    return [int.from_bytes(raw[i:i + 4], "little") for i in range(0, len(raw), 4)]


@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_chunks_give_the_ids_of_the_whole_text(sides, libraries, text):
    a, b = libraries
    assert ids_of(sides.tokens[0].ids([" " + text])[0]) == a.encode(
        " " + text, add_special_tokens=False).ids
    assert ids_of(sides.tokens[1].ids([" " + text])[0]) == b.encode(text)


def wanted_rows(sides, libraries, texts):
    """Plain results: (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) by place."""
    a, b = libraries
    found, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        ours = [(i, sides.tokens[0].bytes[i]) for i in
                (a.encode(" " + text, add_special_tokens=False).ids if text else [])]
        theirs = [(i, sides.tokens[1].bytes[i]) for i in (b.encode(text) if text else [])]
        if not text or any(b"".join(x for _, x in t) != whole for t in (ours, theirs)):
            ours, theirs = [], []
        groups, links = plain.aligned(ours, theirs)
        counts.update(links)
        found.append((ours, theirs, groups, links))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    for ours, theirs, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (len(ours), len(theirs), len(groups), len(links),
               sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
               hashlib.sha256(text.encode()).hexdigest() if ours else "")


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [None, "", " ", "\n", "a", "one two", "one two", "a▁b", "<|endoftext|> <s> <0x0A>",
       "x" * 3000, "né 😀  　 \x00 ß", "  two  blanks \t\n", "ﬁ ｆ", "word " * 300]


@pytest.mark.parametrize("hot", [1 << 20, 8, 0])
def test_documents_against_plain(make_docs, sides, libraries, documents, hot):
    texts = ODD + [r.text[:1200] for r in documents.orderBy("doc_id").limit(12).collect()]
    rows = align_tokenizers(make_docs(texts), A, B, hot_pairs=hot).collect()
    found = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in rows}
    assert found == dict(enumerate(wanted_rows(sides, libraries, texts)))


def test_repeated_ids_and_empty_tables(make_docs, no_docs, sides, libraries):
    texts = ["one two", "three", None]
    rows = align_tokenizers(make_docs(texts, [5, 5, None]), A, B).collect()
    found = sorted(tuple(r[n] for n in NAMES) for r in rows)
    assert found == sorted(wanted_rows(sides, libraries, texts))
    assert align_tokenizers(no_docs, A, B).collect() == []

"""The pipeline against the plain versions of its stages."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from facetlake.llm import privacy, quality
from tests.llm import plain
from tests.llm.conftest import FOLDER


@pytest.fixture(scope="module")
def wanted(document_rows):
    kept = plain.kept_by_quality(document_rows, quality.LEAST_SPREAD, quality.LEAST_ROWS,
                                 quality.CUTOFF)
    rows = [(i, t) for i, t, _, _ in document_rows if kept[i]]
    texts = plain.without_similar_lines(rows)
    rows = [(i, texts[i]) for i, t in rows if texts[i] == t or plain.WORD.search(texts[i])]
    near = plain.near_components(rows)
    return [(i, plain.masked(t, plain.base_spans(t))) for i, t in rows if near[i][1] == i]


def test_stages_equal_the_plain_ones(spark, wanted):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = set()
    for i, text in wanted:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], dtype="<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            pieces.add((i, piece, at, len(part), zlib.crc32(part.tobytes())))
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {tuple(r)[:5] for r in rows} == pieces
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 4096


def test_stages_keep_the_columns_and_survive_odd_rows(spark, odd_docs, no_docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "lines", "near_copies", "privacy", "packing"]
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, FOLDER).columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
        assert packed.where("piece = 0").count() == docs.count()


def test_privacy_stage_leaves_no_base_span(spark, make_docs):
    docs = make_docs(["mail a@b.com now", "+1 (212) 555-1234 and 10.0.0.1", "clean"])
    masked = corpus_pipeline.privacy(spark, docs, FOLDER)
    assert privacy.span_table(masked).where("size(spans) > 0").count() == 0
    assert {r["text"] for r in masked.collect()} == {
        "mail [EMAIL] now", "[PHONE] and [IP]", "clean"}

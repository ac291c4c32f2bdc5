"""The stored term tables of the documents."""

from conformance import inputs
from facetlake.operators import index_tables

FOLDER = "/root/testdata/sf0.001"


def test_words_are_written_once_and_serve_as_postings_and_positions(spark, monkeypatch):
    """Every word of a text costs one row on disk, in files that hold so much text at most."""
    monkeypatch.setattr(inputs, "_BUILT", {})
    monkeypatch.setattr(index_tables, "TASK_BYTES", 1 << 14)
    index, lazy = inputs.stored_index(spark, FOLDER), inputs.fresh_index(spark, FOLDER)
    files = index.postings.inputFiles()
    assert sorted(files) == sorted(index.positions.inputFiles())
    size = inputs.table(spark, FOLDER, "documents").selectExpr("sum(octet_length(text))").first()[0]
    assert len([f for f in files if "field=text" in f]) > size // (1 << 14) // 2
    for name in index_tables.TermIndex.names():
        one, other = getattr(index, name), getattr(lazy, name)
        columns = sorted(other.columns)
        assert one.count() == other.count()
        assert one.select(columns).exceptAll(other.select(columns)).isEmpty()


def test_no_rows_are_laid_down_before_the_index(spark, monkeypatch):
    monkeypatch.setattr(inputs, "_BUILT", {})

    def unwanted(_):
        raise AssertionError("laid down")

    monkeypatch.setattr(index_tables, "lay_down", unwanted)
    assert inputs.stored_index(spark, FOLDER).term_stats.count() > 0


def test_stemmed_queries_split_and_stem_the_texts_once(spark, monkeypatch):
    """Statistics, postings and positions of a stemmed field come from the same stored words."""
    from conformance import searching

    monkeypatch.setattr(inputs, "_BUILT", {})
    index = searching.stemmed_index(spark, FOLDER)
    assert all("/words/" in f for f in index.postings.inputFiles())
    assert sorted(index.postings.inputFiles()) == sorted(index.positions.inputFiles())
    assert searching.stemmed_index(spark, FOLDER).postings.inputFiles() == index.postings.inputFiles()
    lazy = index_tables.build_term_index(
        index.ids, searching.stemmed_texts(spark, FOLDER), searching.STEMMED)
    for name in index_tables.TermIndex.names():
        one, other = getattr(index, name), getattr(lazy, name)
        columns = sorted(other.columns)
        assert one.count() == other.count()
        assert one.select(columns).exceptAll(other.select(columns)).isEmpty()

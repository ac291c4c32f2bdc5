"""Every registered query against its SQL on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from conformance.check import compare, connect
from conformance.suite import CASES

FOLDER = "/root/testdata/sf0.001"
# Queries that have no rows on the smallest tables; all others must return some.
EMPTY = {"documents_to_delete"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(CASES))
def test_query(spark, con, name):
    problem = compare(spark, con, FOLDER, name)
    assert problem == ("EMPTY" if name in EMPTY else ""), problem


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_page_without_keywords_needs_no_term_tables(spark, monkeypatch):
    from conformance import searching

    def unwanted(*_):
        raise AssertionError("term tables were built")

    monkeypatch.setattr(searching, "stored_index", unwanted)
    assert CASES["page"].query(spark, FOLDER).count() > 0


def test_records_are_assembled_once_for_their_exports(spark):
    """Three look-ups read the documents; none of them computes them again."""
    files = CASES["export_record"].query(spark, FOLDER).inputFiles()
    assert not [f for f in files if "lineitem" in f or "customer" in f]


def test_result_items_decode_what_belongs_to_the_page_alone(spark, monkeypatch):
    from conformance import assembly

    laid = []
    real = assembly.plan.lay_down

    def counted(df):
        laid.append(real(df))
        return laid[-1]

    monkeypatch.setattr(assembly.plan, "lay_down", counted)
    files = CASES["result_items"].query(spark, FOLDER).inputFiles()
    assert not [f for f in files if "orders.parquet" in f or "customer" in f]
    kept, owned = laid
    assert kept.count() == 100
    assert owned.join(kept.select(F.col("item_key").alias("parent_item")), "parent_item",
                      "left_anti").isEmpty()

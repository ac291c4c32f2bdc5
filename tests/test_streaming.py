import pytest
from pyspark.sql import functions as F

from facetlake.sources.store import DocumentStore
from facetlake.streaming.refresh import apply_changes, refresh_stream


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    first = [(f"k{i % 5}", i, f"v{i}", False) for i in range(10)]
    second = [("k0", 20, "new", False), ("k1", 21, "", True), ("k2", 3, "stale", False),
              ("k9", 22, "added", False)]
    schema = "id string, version long, text string, deleted boolean"
    store = DocumentStore(spark, str(tmp_path / "store"))
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = refresh_stream(stream, store, str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
    found = {r["id"]: (r["version"], r["text"]) for r in store.read("docs").collect()}
    assert found == {"k0": (20, "new"), "k2": (7, "v7"), "k3": (8, "v8"), "k4": (9, "v9"),
                     "k9": (22, "added")}
    before = store.latest()["number"]
    replay = spark.createDataFrame([("k0", 99, "again", False)], schema)
    apply_changes(store, replay, 1, "id", "version", "deleted", stream=str(tmp_path / "checkpoint"))
    assert store.latest()["number"] == before
    assert store.read("docs").filter(F.col("text") == "again").isEmpty()


def test_built_store_tombstones_and_other_tables(spark, tmp_path):
    schema = "id string, version long, text string, deleted boolean"
    store = DocumentStore(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([("a", 1, "old")], "id string, version long, text string")
    store.publish({"docs": docs, "side": docs.select("id")}, library_version=100)
    path = store.latest()["tables"]["side"]["path"]
    batches = [[("a", 9, "", True), ("b", 2, "new", False)], [("a", 7, "late", False)],
               [("b", 1, "late", False), ("c", 3, "added", False)]]
    for number, rows in enumerate(batches):
        changes = spark.createDataFrame(rows, schema)
        apply_changes(store, changes, number, "id", "version", "deleted", stream="s")
    found = {r["id"]: r["text"] for r in store.read("docs").collect()}
    assert found == {"b": "new", "c": "added"}
    assert {r["id"]: r["version"] for r in store.read("tombstones").collect()} == {"a": 9}
    assert store.latest()["library_version"] == 100 and store.read("side").count() == 1
    assert store.latest()["tables"]["side"]["path"] == path


def test_a_store_with_term_tables_is_refused(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([("a", 1, "old")], "id string, version long, text string")
    postings = docs.select(F.lit("f").alias("field"), F.lit("t").alias("term"), "id")
    store.publish({"docs": docs, "postings": postings}, 1)
    changes = docs.withColumn("deleted", F.lit(False))
    with pytest.raises(ValueError, match="term tables"):
        apply_changes(store, changes, 0, "id", "version", "deleted")


def test_states_of_the_derived_library_share_their_tables(spark):
    """Item, collection and tag rows are made once, whatever the number of synchronisations."""
    from conformance.derived_library import library_states
    library = library_states(spark, "/root/testdata/sf0.001")
    first, last = library(0), library(2)

    def folders(df):
        return {f.rsplit("/", 1)[0] for f in df.inputFiles()}

    for name in ("item", "item_collection", "item_tag"):
        found = folders(getattr(first, name))
        assert found == folders(getattr(last, name)) and all("laid-down" in f for f in found)
    assert first.item.where("data LIKE '%Draft%'").count() > 0
    assert last.item.where("data LIKE '%Draft%'").count() == 0
    assert first.deleted_item.isEmpty() and not last.deleted_item.isEmpty()

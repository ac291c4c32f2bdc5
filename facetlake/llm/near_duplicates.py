"""Near-duplicate documents by MinHash with one permutation, exact in what it confirms.

Equal sets are one class from the start, so copies cost nothing further. Classes that share a
bucket of a band are candidates, along stars (see ``stars``), and confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.llm import shingles as sh
from facetlake.llm.components import components
from facetlake.llm.scratch import small, stored
from facetlake.llm.stars import linked

PERCENT = 75


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _bytes(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    body = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs[id_column].alias("id"), F.xxhash64(body).alias("t"),
                       body.cast("binary").alias("b"))


def document_sketches(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", rows: int = 512
) -> DataFrame:
    """``id, t, n, k1, k2, b1, b2, bands``: hash of the text, size and key of the shingle set,
    128 sketch bits and the band keys; without words ``n`` is 0 and the last five are null."""
    schema = T.StructType([
        T.StructField("id", docs.schema[id_column].dataType),
        *[T.StructField(c, T.LongType()) for c in ("t", "n", "k1", "k2", "b1", "b2")],
        T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, rows):
            found = []
            for one in sh.shingle_sets(batch.column(2).to_pylist()):
                if len(one):
                    values = sh.sketch(one)
                    found.append((len(one), *sh.set_key(one), *sh.sketch_bits(values).tolist(),
                                  sh.band_keys(values)))
                else:
                    found.append((0, None, None, None, None, None))
            columns = list(zip(*found)) if found else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *[pa.array(c, pa.int64()) for c in columns[:5]],
                 pa.array(columns[5], pa.list_(pa.int64()))], names=schema.names)

    return _bytes(docs, id_column, text).mapInArrow(run, schema)


def document_sets(docs: DataFrame, id_column: str, text: str, rows: int = 256) -> DataFrame:
    """``id, members``: the sorted distinct shingle hashes."""
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType),
                           T.StructField("members", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, rows):
            found = [s.view(np.int64) for s in sh.shingle_sets(batch.column(2).to_pylist())]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(ends), pa.array(np.concatenate(found) if found else [], pa.int64()),
                type=pa.list_(pa.field("element", pa.int64(), nullable=False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=schema.names)

    return _bytes(docs, id_column, text).mapInArrow(run, schema)


def _differing(a: str, b: str) -> Column:
    """How many of 128 sketch bits two rows don't share."""
    return F.bit_count(F.col(f"{a}.b1").bitwiseXOR(F.col(f"{b}.b1"))) + F.bit_count(
        F.col(f"{a}.b2").bitwiseXOR(F.col(f"{b}.b2")))


def _may_link(a: str, b: str) -> Column:
    """Whether the sizes of two sets allow the similarity; sketch bits only order candidates."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)


def class_links(
    classes: DataFrame, docs: DataFrame, id_column: str, text: str, repeated: bool
) -> DataFrame:
    """``node, component`` of the linked classes (``id, n, b1, b2, bands``, one row each).

    An id that stands for several classes is one node with several sets; ``repeated`` says that
    ids may repeat at all."""
    banded = classes.where("n >= 3").select("id", "n", "b1", "b2", F.explode("bands").alias("key"))
    common = stored(
        banded.groupBy("key").agg(F.min("id").alias("i0"), F.max("id").alias("i1"))
        .where("i0 <> i1").select("key"), "near-buckets")
    shared = stored(banded.join(small(common, 16), "key"), "near-shared")
    ids = stored(shared.select("id").distinct(), "near-ids")
    named = docs.select(docs[id_column].alias("id"), docs[text].alias("text")).join(
        small(ids, 24), "id", "left_semi")
    if repeated:
        named = named.distinct()
    sets = stored(document_sets(named, "id", "text"), "near-sets")

    return linked(shared, sets, PERCENT, _may_link, _differing, "near")


def _resolved(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``id, t, n, component`` of every row."""
    sketches = stored(document_sketches(docs, id_column, text), "near-sketches")
    filled = sketches.where("n > 0 AND id IS NOT NULL")
    classes = stored(
        filled.groupBy("n", "k1", "k2").agg(F.min("id").alias("rep")), "near-classes")
    classed = filled.join(classes, ["n", "k1", "k2"])
    again = stored(filled.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where(
        "rows > 1").select("id"), "near-repeated")
    repeated = not again.isEmpty()
    representatives = classed.where("id = rep").select("id", "n", "k1", "k2", "b1", "b2", "bands")
    if repeated:
        representatives = representatives.dropDuplicates(["id", "n", "k1", "k2"])
    labels = class_links(
        representatives.drop("k1", "k2"), docs, id_column, text, repeated)
    if repeated:
        # An id brings the classes of all its texts together.
        several = stored(classed.join(again, "id").select("id", "rep").distinct(), "near-several")
        least = several.groupBy("id").agg(F.min("rep").alias("component"))
        labels = components(labels.union(several.join(least, "id").select("rep", "component")))
    # Each class by its component; joined back on the set's key.
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n", "k1", "k2", F.coalesce("component", "rep").alias("component"))
    empty = sketches.where("n = 0 OR id IS NULL").select(
        "id", "t", "n", F.col("id").alias("component"))
    return filled.join(named, ["n", "k1", "k2"]).select("id", "t", "n", "component").unionByName(
        empty)


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every document.

    Documents are linked if 100 times the intersection of their sets of five-word shingles is at
    least 75 times the union; a component is kept by its smallest id.

    Defined cases: null texts and texts without words have an empty set and stay alone; a text
    of fewer than five words is one shingle; an id with several texts is one document that is
    linked wherever one of its texts is, and its rows are all kept if the component bears its id;
    a null id has a null component and is kept; an empty table gives no
    rows. Reads only the two named columns.
    """
    return _resolved(docs, id_column, text).select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def keep_one_of_each(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    gone = stored(_resolved(docs, id_column, text).where("id <> component").select(
        F.col("id").alias("_gone_id"), F.col("t").alias("_gone_text")).distinct(), "near-removed")
    return docs.join(
        small(gone, 32), (docs[id_column] == F.col("_gone_id"))
        & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("_gone_text")), "left_anti")

"""Versioned document tables on shared storage.

A version is a folder holding all tables of one build. It becomes visible through a row in
the ``commits`` table, written last: readers see either the old or the new set of tables.

Tables keyed by a document may lie in folders by a hash bucket of its id. A version then writes
the buckets it touches, whole, and points at the folders of all others where they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Collection, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

COMMITS = (
    "number bigint, folder string, "
    "tables map<string,struct<path:string,ddl:string,buckets:array<string>>>, "
    "library_version int, synced_on timestamp, stream string, batch bigint, n_buckets int"
)


class IndexMissingError(FileNotFoundError):
    """Nothing has been built yet."""


class IndexEmptyError(ValueError):
    """The tables are readable but hold no document."""


class IndexSchemaError(ValueError):
    """The tables do not have the expected columns."""


# Layout per table: hive partition columns and the order of rows within the files.
LAYOUT: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "docs": ((), ("id",)),
    "texts": (("field",), ("id",)),
    "postings": (("field",), ("term", "id")),
    "positions": (("field",), ("term", "id")),
    "term_stats": ((), ("field", "term")),
    "deps": (("kind",), ("dep", "id")),
    "edges": (("rel",), ("ref", "src")),
}


# Tables of a row per word and document. Their rows stay in the tasks they come in: each file
# holds some documents, sorted by word, and a search reads the pages of its words in every file.
UNMOVED = ("postings", "positions")


def write_table(df: DataFrame, name: str, path: str) -> None:
    """Write one table in its layout.

    Range keys end with a unique column, so a frequent value spans several files.
    """
    partitions, order = LAYOUT.get(name, ((), ()))
    if order:
        keys = [*partitions, *order]
        if name not in UNMOVED:
            df = df.repartitionByRange(*keys)
        df = df.sortWithinPartitions(*keys)
    writer = df.write.mode("overwrite")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)


BUCKET = "bucket"
# Buckets of a new store. More of them make a refresh write less, and more and smaller files.
BUCKETS = 32
# Tables written at a time.
WRITERS = 4


def bucket_of(key: Column, n_buckets: int) -> Column:
    """The hash bucket of a document id."""
    return F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int")


def write_buckets(df: DataFrame, name: str, path: str, n_buckets: int) -> list[str]:
    """Write a table with a column ``bucket`` as one folder per bucket; returns those folders.

    A bucket is dealt to several tasks by a further part of the id's hash when there are more
    tasks than buckets; each file is in the table's order. Unlike ranges, that needs no sample,
    so the table is computed once.
    """
    partitions, order = LAYOUT.get(name, ((), ()))
    keys = [c for c in ("id", "src") if c in df.columns][:1]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = [F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(max(1, tasks // n_buckets)))] if keys else []
    df.repartition(BUCKET, *part).sortWithinPartitions(
        BUCKET, *partitions, *(order or keys)).write.mode("overwrite").partitionBy(
        BUCKET).parquet(path)
    files = df.sparkSession.read.schema(df.schema).parquet(path).inputFiles()
    found = {int(m[1]) for f in files if (m := re.search(rf"/{BUCKET}=(\d+)/", f))}
    return [f"{path}/{BUCKET}={b}" for b in sorted(found)]


def _number(folder: str) -> int:
    return int(folder.rsplit("=", 1)[1])


def schema_ddl(df: DataFrame) -> str:
    """The columns and types of a table as text."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


class DocumentStore:
    """Reads and replaces the document tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")
        except AnalysisException:
            return None

    def latest(self):
        """The last commit as a row, or None."""
        commits = self._commits()
        if commits is None:
            return None
        row = commits.agg(F.max_by(F.struct("*"), "number").alias("c")).first()
        return row["c"] if row else None

    def read(
        self, name: str, buckets: Collection[int] | None = None, commit: Row | None = None
    ) -> DataFrame:
        """One table of the current version, or of ``commit``, with the schema it was written
        with; of a table in buckets only the listed ones."""
        commit = commit or self.latest()
        if commit is None:
            raise IndexMissingError(self.root)
        kept = commit["tables"].get(name)
        if kept is None:
            raise IndexSchemaError(f"no table {name!r} in version {commit['number']}")
        folders = [kept["path"]] if kept["buckets"] is None else [
            f for f in kept["buckets"] if buckets is None or _number(f) in buckets]
        if not folders:
            return self.spark.createDataFrame([], kept["ddl"])
        return self.spark.read.schema(kept["ddl"]).parquet(*folders)

    def last_batch(self, stream: str) -> int | None:
        """The newest batch of a stream that has been applied."""
        commits = self._commits()
        if commits is None:
            return None
        return commits.filter(F.col("stream") == stream).agg(F.max("batch")).first()[0]

    def open(self, expected_columns: list[str] | None = None) -> DataFrame:
        """The documents, checked to exist, to have the columns, and not to be empty."""
        docs = self.read("docs")
        missing = set(expected_columns or ()) - set(docs.columns)
        if missing:
            raise IndexSchemaError(f"unknown columns: {sorted(missing)}")
        if docs.isEmpty():
            raise IndexEmptyError(self.root)
        return docs

    def count(self) -> int:
        """Number of documents."""
        return self.read("docs").count()

    def publish(
        self, tables: Mapping[str, DataFrame], library_version: int | None = None,
        synced_on=None, batch: str | None = None, carry: bool = False,
        stream: str | None = None, batch_id: int | None = None,
        n_buckets: int | None = None, touched: Collection[int] | None = None,
    ) -> str:
        """Write the tables of a new version, then commit it; returns its folder.

        With ``carry`` the other tables of the last version stay, as they lie: nothing of them is
        copied. ``stream`` and ``batch_id`` note the micro-batch that the version applies.

        With ``n_buckets`` the tables that have a column ``bucket`` are written by bucket;
        ``touched`` lists the buckets that they hold whole, the others stay as they lie.

        The tables are written side by side: one whose last tasks run leaves cores to the next.

        One writer at a time: readers may come and go, but refreshes must not overlap.

        ``batch`` names the folder, so that a repeated batch overwrites its own attempt.
        """
        previous = self.latest()
        number = (previous["number"] if previous else 0) + 1
        folder = f"{self.root}/versions/{number:08d}-{batch or uuid.uuid4().hex[:8]}"
        old = previous["tables"] if previous else {}
        kept = dict(old) if carry else {}

        def write(name: str, df: DataFrame) -> tuple:
            path = f"{folder}/{name}"
            if n_buckets is None or BUCKET not in df.columns:
                write_table(df, name, path)
                return path, schema_ddl(df), None
            stay = [] if touched is None or name not in old else [
                f for f in old[name]["buckets"] or () if _number(f) not in touched]
            fresh = write_buckets(df, name, path, n_buckets)
            return path, schema_ddl(df.drop(BUCKET)), [*stay, *fresh]

        with ThreadPoolExecutor(WRITERS) as pool:
            # Each call carries the job group and the like of the caller to its thread.
            jobs = {name: pool.submit(inheritable_thread_target(self.spark)(write), name, df)
                    for name, df in tables.items()}
            kept |= {name: job.result() for name, job in jobs.items()}
        row = [(number, folder, kept, library_version, synced_on, stream, batch_id, n_buckets)]
        self.spark.createDataFrame(row, COMMITS).coalesce(1).write.mode("append").parquet(
            f"{self.root}/commits"
        )
        return folder


def upsert_documents(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Replace rows of the same key, add the others."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete_documents(old: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not listed."""
    return old.join(keys.select(key), key, "left_anti")


def document_count(docs: DataFrame) -> DataFrame:
    """S9 as a one-row table."""
    return docs.agg(F.count(F.lit(1)).alias("documents"))

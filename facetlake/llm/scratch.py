"""Intermediate tables in the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.session import scratch_dir

# Rows times width a side may have to be sent to every executor; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
# Removes the shuffle files of a query when it ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables. It may be deleted when the
    results have been written."""
    return f"{scratch_dir(spark)}/facetlake-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage: a lost executor costs the tasks that read the table, never the work that
    made it, and random or order-dependent values in it are fixed. The files that were shuffled for
    it go as soon as it is written, not when the driver's memory happens to be collected.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, marked for broadcast if its counted rows fit the bound. ``df`` must be stored."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df

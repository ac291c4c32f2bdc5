"""Session construction and the shared scratch folder."""

from __future__ import annotations

import logging
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHOSEN: dict[str, str] = {}


def local_session(name: str = "facetlake", cores: str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FACETLAKE_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for materialised intermediate tables.

    Taken from ``spark.checkpoint.dir``; where that is unset, a local session gets a folder of
    its own. On a cluster a machine-local path is invisible to the other executors, so there the
    setting is required. ``spark.checkpoint.dir`` cannot be set once a session runs: the chosen
    folder is kept here, per application.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or _CHOSEN.get(context.applicationId)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = _CHOSEN[context.applicationId] = tempfile.mkdtemp(prefix="facetlake-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``; partition order and row order are kept."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def lay_down(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again, in no particular order.

    Cuts the lineage like a checkpoint, in a fraction of its bytes, and later steps read only
    the columns they need.
    """
    path = f"{scratch_dir(df.sparkSession)}/laid-down/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

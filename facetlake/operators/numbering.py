"""Positions in a global order, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.session import lay_down

_SLOT_BITS = 33


def global_positions(
    df: DataFrame, order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """Number all rows from 1 in ``order``, which must be total (end with a unique key).

    A range-partitioned sort is laid down together with the partition and place of each row;
    rows are then counted per partition and each partition is shifted by the rows before it. The
    only window runs over one row per partition.
    """
    ordered = lay_down(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftright("_slot", _SLOT_BITS))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per sort partition: bounded by the partition count, whatever the data size.
    within = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return ordered.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + within + 1).alias(name)
    )

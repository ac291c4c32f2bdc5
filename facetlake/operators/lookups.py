"""Records by id, falling back to an alternate id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_ids(requests: DataFrame, docs: DataFrame, alternate_ids: DataFrame) -> DataFrame:
    """``request, id, fellback``: one row per request, NULL id if nothing matches.

    The first hit of an alternate id is the smallest id.
    """
    wanted = requests.select("request").distinct()
    by_id = docs.select(F.col("id").alias("request"), F.col("id").alias("direct"))
    by_other = (
        alternate_ids.join(wanted, alternate_ids["alternate_id"] == wanted["request"], "left_semi")
        .groupBy(F.col("alternate_id").alias("request"))
        .agg(F.min("id").alias("other"))
    )
    return (
        wanted.join(by_id, "request", "left").join(by_other, "request", "left")
        .select(
            "request",
            F.coalesce("direct", "other").alias("id"),
            (F.col("direct").isNull() & F.col("other").isNotNull()).alias("fellback"),
        )
    )

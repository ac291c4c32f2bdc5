import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from facetlake.session import local_session  # noqa: E402


# Started on import: test modules build column expressions at their top level.
_SESSION = local_session("tests", "8")
_SESSION.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="session")
def spark():
    return _SESSION


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one column expression over one row."""
    from pyspark.sql import functions as F

    def evaluate(column, **inputs):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
        return row.select(column.alias("v")).first()["v"]

    return evaluate

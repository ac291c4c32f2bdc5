"""Run queries and their SQL side by side: ``python -m conformance.check [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from conformance.suite import CASES
from facetlake.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
              "double": "DOUBLE", "timestamp": "TIMESTAMP"}


def _difference(ours: str, theirs: str) -> str:
    same = next((i for i, (a, b) in enumerate(zip(ours, theirs)) if a != b),
                min(len(ours), len(theirs)))
    start = max(same - 80, 0)
    return f"{ours[:40]}..{ours[start:same + 80]!r} != {theirs[start:same + 80]!r}"


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder: str, name: str) -> str:
    """Empty when equal, else what differs."""
    case = CASES[name]
    found = case.query(spark, folder)
    spark_rows = rows_of(found.columns, found.collect())
    if case.sql is None:
        return "" if spark_rows else "no rows"
    result = con.execute(case.sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != sorted(found.columns):
        return f"columns {sorted(found.columns)} != {sorted(columns)}"
    wanted = rows_of(columns, result.fetchall())
    if len(wanted) != len(spark_rows):
        return f"{len(spark_rows)} rows, expected {len(wanted)}"
    for ours, theirs in zip(spark_rows, wanted):
        if ours != theirs:
            return _difference(str(ours), str(theirs))
    kinds = {c[0]: str(c[1]) for c in result.description}
    for column, kind in found.dtypes:
        if kind in DUCK_TYPES and kinds[column] != DUCK_TYPES[kind]:
            return f"type of {column}: {kind} != {kinds[column]}"
    return "" if wanted else "EMPTY"


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(CASES)
    spark, con = local_session("check", "8"), connect(folder)
    bad = []
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok ' if not problem else 'BAD'} {name} {time.time() - start:.2f}s "
              f"{'' if CASES[name].sql else '(rows only)'} {problem}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} ok; bad: {bad}")


if __name__ == "__main__":
    main()

"""Runs queries beside their SQL: python -m workload.check [sf_dir] [query ...]"""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: str = "8", partitions: int = 8) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("placebook").config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="placebook-"))
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
    spark = builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def sort_key(row: tuple):
    return [(value is None, str(type(value)), value if value is not None else 0) for value in row]


def rows_by_name(names: list[str], rows: list[tuple]) -> list[tuple]:
    places = [names.index(name) for name in sorted(names)]
    return sorted((tuple(row[i] for i in places) for row in rows), key=sort_key)


def differences(got: list[tuple], expected: list[tuple]) -> list[tuple]:
    def same(a, b):
        if isinstance(a, float) and isinstance(b, float):
            return a == b or (math.isnan(a) and math.isnan(b))
        return a == b and type(a) is type(b)

    pairs = [(a, b) for a, b in zip(got, expected) if len(a) != len(b) or not all(map(same, a, b))]
    return pairs


def compare(connection: duckdb.DuckDBPyConnection, name: str, df: DataFrame) -> tuple[bool, str]:
    from workload.oracle import ORACLE

    got = rows_by_name(df.columns, [tuple(row) for row in df.collect()])
    result = connection.execute(ORACLE[name])
    names = [column[0] for column in result.description]
    expected = rows_by_name(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    wrong = differences(got, expected)
    if len(got) != len(expected) or wrong:
        return False, f"{len(got)} against {len(expected)} rows, {len(wrong)} differ, such as {wrong[:2]}"
    return True, f"{len(got)} rows"


def main() -> int:
    from workload.queries import QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, connection, failed = session(), connect(sf_dir), 0
    for name in sys.argv[2:] or QUERIES:
        try:
            start = time.time()
            fine, message = compare(connection, name, QUERIES[name](spark, sf_dir))
            message += f", {time.time() - start:.1f} s"
        except Exception as problem:  # noqa: BLE001 - reported, and the others still run
            fine, message = False, f"{type(problem).__name__}: {str(problem)[:1500]}"
        failed += not fine
        print("ok  " if fine else "FAIL", name, message, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())

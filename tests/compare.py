"""Run registered queries next to their SQL twins and compare every value.

    python -m tests.compare [sf folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, int):
        return value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    out.sort(key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
    return names, out


def difference(df, sql: str, con) -> str | None:
    """None when both sides return the same multiset of rows, else what differs."""
    spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    sql_rows = rows_of(names, result.fetchall())
    if spark_rows[0] != sql_rows[0]:
        return f"columns {spark_rows[0]} against {sql_rows[0]}"
    if len(spark_rows[1]) != len(sql_rows[1]):
        return f"{len(spark_rows[1])} rows against {len(sql_rows[1])}"
    bad = [(a, b) for a, b in zip(spark_rows[1], sql_rows[1]) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first {dict(zip(spark_rows[0], zip(*bad[0])))}"
    kinds = [
        (name, type(a), type(b))
        for name, a, b in zip(spark_rows[0], spark_rows[1][0], sql_rows[1][0])
        if type(a) is not type(b)
    ] if spark_rows[1] else []
    return f"types {kinds}" if kinds else None


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main(arguments: list[str]) -> int:
    import __spark_entry__ as entry

    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    queries, sql = entry.queries(), entry.oracle_sql()
    wanted = arguments[1:] or list(queries)
    spark, con, failed = session(), connect(folder), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                problem = difference(df, sql[name], con)
                outcome = "same" if problem is None else f"DIFFERS {problem}"
            else:
                problem, outcome = None, f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            problem, outcome = "error", f"ERROR {str(error)[:1500]}"
        failed += problem is not None
        print(f"{name:32s} {time.time() - start:6.1f}s  {outcome}", flush=True)
    print(f"{len(wanted)} queries, {failed} wrong")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

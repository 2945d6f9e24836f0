"""Run registered queries and their SQL side by side: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else v)
    if type(v).__name__ == "Decimal":
        return _plain(float(v))
    return v


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def _close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, int):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def check(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty text when the results agree, else what differs."""
    df = query(spark, sf_dir)
    got = df.collect()
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    spark_types = dict(df.dtypes)
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date"}
    odd = [f"{c}: {spark_types[c]} / {types[c]}" for c in columns if kinds.get(types[c], types[c]) != spark_types[c]]
    a, b = _rows(df.columns, got), _rows(columns, want)
    note = f" types {odd}" if odd else ""
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}{note}"
    if not a:
        return "no rows"
    exact = sum(1 for x, y in zip(a, b) if x != y)
    loose = [(x, y) for x, y in zip(a, b) if not all(map(_close, x, y))]
    if loose:
        return f"{len(loose)} of {len(a)} rows differ, first {loose[0]}{note}"
    if exact:
        return f"{exact} rows differ in the last digits{note}"
    return note


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in oracles:
                result = check(spark, con, name, queries[name], oracles[name], sf_dir)
            else:
                result = f" rows only: {len(queries[name](spark, sf_dir).collect())}"
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok ' if not result or result.startswith(' ') else 'BAD'} {name} {time.time() - start:.1f}s{result}", flush=True)


if __name__ == "__main__":
    main()

"""Compare catalog queries with their SQL counterparts on the same tables.

    python tests/compare.py [data folder] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, bool):
        return value
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def differences(spark, con, name: str, query, sql: str, sf_dir: str) -> list[str]:
    """Empty when both sides agree on columns, rows and values."""
    df = query(spark, sf_dir)
    relation = con.sql(sql)
    ours, theirs = list(df.columns), list(relation.columns)
    if sorted(ours) != sorted(theirs):
        return [f"{name}: columns {sorted(ours)} != {sorted(theirs)}"]
    left = rows_of(ours, [tuple(r) for r in df.collect()])
    right = rows_of(theirs, relation.fetchall())
    if len(left) != len(right):
        return [f"{name}: {len(left)} rows != {len(right)}"]
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return [f"{name}: {len(bad)} of {len(left)} rows differ, first {a}\n   != {b}" for a, b in bad[:1]]


def main() -> int:
    import __spark_entry__ as spark_entry
    from vigilark.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(sf_dir), spark_entry.queries(), spark_entry.oracle_sql()
    failed = []
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in sql:
                found = differences(spark, con, name, queries[name], sql[name], sf_dir)
            else:
                rows = queries[name](spark, sf_dir).collect()
                found = [] if rows else [f"{name}: no rows"]
                print("   ", rows[:6])
        except Exception:
            found = [f"{name}: {traceback.format_exc()[-1500:]}"]
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s", flush=True)
        if found:
            print("   ", *found, flush=True)
            failed.append(name)
    missing = sorted(set(sql) - set(queries))
    print("failed:", failed, "without query:", missing, "without sql:", sorted(set(queries) - set(sql)))
    return 1 if failed or missing else 0


if __name__ == "__main__":
    sys.exit(main())

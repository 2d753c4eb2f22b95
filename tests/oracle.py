"""Compare registered queries with their SQL on one folder of tables.

Usage: python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _sort_key(row):
    return tuple((v is None, type(v).__name__ if isinstance(v, str) else "", "" if v is None else v) for v in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(plain, key=_sort_key)


def difference(spark, con, folder, query, sql) -> str | None:
    """None when both sides agree in columns, rows and values, otherwise what differs."""
    df = query(spark, folder)
    ours = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(bad)} of {len(ours[1])} rows differ, first:\n  {bad[0][0]}\n  {bad[0][1]}" if bad else None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from lakeprofile.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, sql = local_session(8), connect(folder), oracle_sql()
    failed = 0
    for name, query in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = difference(spark, con, folder, query, sql[name])
            else:
                problem = None if query(spark, folder).count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        kind = "sql " if name in sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()

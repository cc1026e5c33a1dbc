"""Compare registered queries with DuckDB on the same tables.

Run ``python tests/oracle.py SF_DIR [key ...]`` for a report; ``ORACLE_TZ`` sets another session zone.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value + 0.0, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark_df, con, sql):
    got = canonical(spark_df.columns, spark_df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want = canonical(names, cursor.fetchall())
    problems = []
    if sorted(spark_df.columns) != sorted(names):
        problems.append(f"columns {sorted(spark_df.columns)} != {sorted(names)}")
    else:
        family = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                  "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
        for c, t in spark_df.dtypes:
            if family.get(t) != kinds[c]:
                problems.append(f"type of {c}: {t} / {kinds[c]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    elif got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        problems.append(f"{len(bad)} rows differ, first {bad[:2]} in {sorted(names)}")
    return len(got), problems


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from featurelake.session import build_session

    sf, keys = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle", "local[8]", 8, "8g")
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("ORACLE_TZ"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["ORACLE_TZ"])
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for key in keys or queries:
        started = time.time()
        try:
            df = queries[key](spark, sf)
            if key in oracles:
                rows, problems = compare(df, con, oracles[key])
            else:
                rows, problems = df.count(), []
        except Exception as error:  # noqa: BLE001
            rows, problems = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
        hard = [p for p in problems if not p.startswith("type of")]
        failed += bool(hard)
        state = "FAIL" if hard else ("ok" if key in oracles else "rows")
        print(f"{state:5}{key:30}{rows:8} {time.time() - started:6.1f}s  {'; '.join(problems)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())

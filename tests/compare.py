"""Run registered queries and their SQL twins side by side.

``python tests/compare.py [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree in columns, types of cells and values."""
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_columns, want = _rows([c[0] for c in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"first difference\n  {a}\n  {b}"
    return None


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from tillstream.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), oracle_sql()
    bad = 0
    for name, run in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in sql:
                problem = difference(run(spark, sf_dir), con, sql[name])
                size = con.execute(f"SELECT count(*) FROM ({sql[name]})").fetchone()[0]
            else:
                problem, size = None, run(spark, sf_dir).count()
        except Exception as error:  # report and go on with the next query
            problem, size = f"{type(error).__name__}: {str(error)[:600]}", "?"
        bad += problem is not None
        note = "" if name in sql else "  (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28s} rows={size} {time.time() - start:.2f}s{note}", flush=True)
        if problem:
            print("     ", problem, flush=True)
    missing = set(sql) - set(queries())
    print(f"{bad} differences, oracles without query: {missing or 'none'}")


if __name__ == "__main__":
    main()

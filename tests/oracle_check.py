"""Run registered queries next to their SQL in DuckDB and compare rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value, digits: int | None):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        if digits is not None and math.isfinite(value):
            value = round(value, digits)
        return value + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v, digits) for v in value)
    return value


def table(names, rows, digits):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i], digits) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(df, con, sql: str, digits: int | None = None) -> str:
    """Empty text when both give the same table, else what differs."""
    left_names, left = table(df.columns, [tuple(r) for r in df.collect()], digits)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    right_names, right = table(names, cursor.fetchall(), digits)
    if left_names != right_names:
        return f"columns {left_names[:8]} vs {right_names[:8]}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    for a, b in zip(left, right):
        for name, x, y in zip(left_names, a, b):
            if x != y or isinstance(x, float) != isinstance(y, float):
                return f"column {name}: {x!r} vs {y!r}"
    return ""


def main(folder: str, wanted: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from cohortlens.session import local_session

    spark = local_session("oracle-check")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                count = df.count()
                problem = "" if count else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        kind = "sql " if name in oracles else "rows"
        print(f"{name:8} {kind} {time.time() - start:6.2f}s {'ok' if not problem else problem}", flush=True)
    print(f"{bad} bad of {len(wanted or queries)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)

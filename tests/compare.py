"""Side-by-side check of a Spark query and its SQL."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def compare(spark, db, run, sql, sf_dir):
    """None when equal, else a short text of what differs; plus both times."""
    t0 = time.time()
    df = run(spark, sf_dir)
    got, names = rows_of(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return None, t1 - t0, 0.0, len(got)
    cursor = db.execute(sql)
    want, expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    t2 = time.time()
    problem = None
    if names != expected:
        problem = f"columns {names} != {expected}"
    elif len(got) != len(want):
        problem = f"rows {len(got)} != {len(want)}; spark only {str([r for r in got if r not in set(want)][:2])[:600]}"
    elif got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        problem = f"{len(bad)} rows differ, first {str(bad[0])[:900]}"
    return problem, t1 - t0, t2 - t1, len(got)

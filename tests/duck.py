"""Compares a query with its SQL in DuckDB on the same tables."""

import os

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return db


def _text(value):
    if isinstance(value, float) and value == value:
        return f"{value:.9g}"
    if value is None or value is pd.NA or value != value:
        return "null"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{value:.9g}" if abs(value) < 1e8 else str(int(value))
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(tuple(_text(v.item() if hasattr(v, "item") else v) for v in r) for r in frame.itertuples(index=False))


def same(spark, db, query, sql):
    assert rows(query(spark, SF_DIR).toPandas()) == rows(db.sql(sql).df())

"""Runs a query and its SQL side by side."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return None if v is None or str(v) in ("nan", "<NA>", "NaT") else v


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


def compare(df, sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, expected = rows_of(df.toPandas()), rows_of(c.sql(sql).df())
    assert got[0] == expected[0]
    assert got[1] == expected[1]

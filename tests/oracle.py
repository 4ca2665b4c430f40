"""Comparison of a Spark result with DuckDB's on the same Parquet tables."""

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return "~"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, np.integer)):
        return str(int(value))
    if isinstance(value, (float, np.floating)):
        return f"{round(float(value), 6) + 0.0:.6f}"
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


def assert_same(spark_df, con, sql):
    got, want = rows(spark_df.toPandas()), rows(con.execute(sql).fetchdf())
    assert got[0] == want[0]
    assert got[1] == want[1]

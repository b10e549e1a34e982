"""Results of Spark and DuckDB, row by row, in no order."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return int(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return float(v)
    if isinstance(v, (list, np.ndarray)):
        return tuple(_value(x) for x in v)
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    data = [[_value(v) for v in df[c].tolist()] for c in columns]
    return sorted(zip(*data, strict=True), key=repr)


def assert_same(spark_df, duck, sql: str) -> None:
    ours, theirs = spark_df.toPandas(), duck.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)

"""Rows of a Spark result and of SQL on the same tables, in one form."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) == "<NA>":
        return None
    if "bool" in type(x).__name__:
        return bool(x)
    if isinstance(x, float):
        return round(float(x), 8)
    return int(x) if hasattr(x, "__index__") else str(x)


def rows(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None)), key=str)


def same(spark_frame, sql_frame):
    columns = sorted(spark_frame.columns)
    assert columns == sorted(sql_frame.columns)
    assert rows(spark_frame, columns) == rows(sql_frame, columns)

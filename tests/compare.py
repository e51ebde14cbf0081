"""Results of Spark and DuckDB as sorted rows that can be compared."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def value(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
        return None
    if isinstance(x, bool):
        return str(x)
    return round(float(x), 5) if isinstance(x, (int, float)) else str(x)


def rows(pdf):
    names = sorted(pdf.columns)
    return names, sorted(repr(tuple(value(x) for x in r)) for r in pdf[names].itertuples(index=False, name=None))

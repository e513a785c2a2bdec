"""Side-by-side runs of the registered queries and their SQL counterparts."""

from __future__ import annotations

import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def sql_tables(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 9) + 0.0 if math.isfinite(value) else str(value)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_cell(row[n]) for n in names) for row in df.collect())


def sql_rows(con, statement):
    relation = con.sql(statement)
    columns = list(relation.columns)
    names = sorted(columns)
    place = [columns.index(n) for n in names]
    return names, Counter(tuple(_cell(row[i]) for i in place) for row in relation.fetchall())


def difference(df, con, statement):
    """None if equal, else a short description."""
    names, ours = spark_rows(df)
    other_names, theirs = sql_rows(con, statement)
    if names != other_names:
        return f"columns {names} against {other_names}"
    if ours != theirs:
        return (
            f"{sum(ours.values())} rows against {sum(theirs.values())}; "
            f"only here {list((ours - theirs).items())[:3]}; only there {list((theirs - ours).items())[:3]}"
        )
    if not ours:
        return "no rows"
    return None

"""Scores from counts, and the hash that drives every reproducible choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return _ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return _ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = precision(tp, fp), recall(tp, fn)
    return _ratio(2 * p * r, p + r)


def with_prf(df, tp: str = "tp", fp: str = "fp", fn: str = "fn"):
    """Add precision, recall and f1 to a table of counts."""
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return df.withColumns({"precision": precision(t, p), "recall": recall(t, n), "f1": f1(t, p, n)})


def hash32(key: Column, seed: int) -> Column:
    """A whole number below 2^32 fixed by a key and a seed, the same on every engine."""
    text = F.concat(key.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_fraction(key: Column, seed: int) -> Column:
    return hash32(key, seed) / F.lit(4294967296.0)

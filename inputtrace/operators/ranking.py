"""Exact row numbers over a whole table without passing it through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import hash32

BUCKETS = 65_536
BUCKET_WIDTH = 2**32 // BUCKETS
# Bounds between ranges of an order.
BOUNDS = 4095


def shuffled_rank(df: DataFrame, key: str, seed: int, total: str | None = None) -> DataFrame:
    """Add ``rank`` from 1 in a reproducible shuffled order of a unique key.

    The hash spreads keys evenly over buckets; a row's rank is its place in its bucket plus
    the sizes of the buckets before it. The broadcast table has one row per bucket.
    ``total`` names a column for the number of rows.
    """
    hashed = df.withColumn("_hash", hash32(F.col(key), seed)).withColumn(
        "_bucket", F.floor(F.col("_hash") / BUCKET_WIDTH)
    )
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    # At most BUCKETS rows, so one task for the running sum is enough.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    offsets = sizes.select(
        "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(whole).alias("_rows_total"),
    )
    inside = Window.partitionBy("_bucket").orderBy("_hash", key)
    ranked = (
        hashed.withColumn("_place", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("rank", F.col("_offset") + F.col("_place"))
    )
    if total:
        ranked = ranked.withColumnRenamed("_rows_total", total)
    return ranked.drop("_hash", "_bucket", "_place", "_offset", "_rows_total")


def _bounds_below(bounds: Column, key: Column) -> Column:
    """How many of the sorted bounds are not above the key, by binary search."""
    steps = F.array(*[F.lit(2**i) for i in reversed(range(BOUNDS.bit_length()))])

    def step(found: Column, width: Column) -> Column:
        return F.when(F.get(bounds, found + width - 1) <= key, found + width).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)


def ordered_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` from 1 in the given total order, nulls first.

    The keys with the smallest hashes are bounds that cut the order into ranges; a row's rank is its
    place in its range plus the sizes of the ranges before it. The bounds depend on the keys alone, so
    whoever computes them again finds the same, and all is one plan. The array of bounds and the
    broadcast table have ``BOUNDS`` entries at most.
    """
    key = F.struct(*order)
    chosen = df.select(key.alias("_key")).orderBy(F.xxhash64(*order), "_key").limit(BOUNDS)
    bounds = chosen.agg(F.array_sort(F.collect_list("_key"))).scalar()
    ranged = df.withColumn("_bounds", bounds).withColumn("_range", _bounds_below(F.col("_bounds"), key)).drop("_bounds")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
        .join(F.broadcast(offsets), "_range")
        .withColumn("rank", F.col("_offset") + F.col("_place"))
        .drop("_range", "_place", "_offset")
    )

"""Counts, timings and other figures about a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: recordings in the whole collection, for the time estimate.
WHOLE_COLLECTION = 2147

# The bracket around the median holds about 4 / ACCURACY of the rows; it is cut into so many
# parts of equal width, and only the part with the median is ordered by value.
ACCURACY = 100_000
PARTS = 4096


def run_counts(recordings: DataFrame, clips: DataFrame) -> DataFrame:
    """Per split: recordings, recordings without any clip, clips."""
    per_recording = clips.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_clips"))
    joined = recordings.join(per_recording, "recording_id", "left").na.fill({"n_clips": 0})
    return joined.groupBy("split").agg(
        F.count(F.lit(1)).alias("recordings"),
        F.count_if(F.col("n_clips") == 0).alias("failed_recordings"),
        F.sum("n_clips").alias("clips"),
    )


def timing_stats(timings: DataFrame, seconds: str, estimate_for: int = WHOLE_COLLECTION) -> DataFrame:
    """Total, mean, upper median and maximum of seconds per recording, and an estimate.

    The exact median is looked up among the few values that an approximate one brackets: counts
    tell the part of the bracket that holds it, and that part alone is ordered.
    """
    value = F.col(seconds)
    stats = timings.agg(
        F.count(value).alias("n"),
        F.sum(value).alias("total"),
        F.max(value).alias("largest"),
        F.percentile_approx(value, [0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY], ACCURACY).alias("band"),
    )
    low, high = stats.select(F.col("band")[0]).scalar(), stats.select(F.col("band")[1]).scalar()
    below = timings.where(value < low).agg(F.count(F.lit(1))).scalar()
    # The value at place n div 2, counted from 0.
    middle = F.floor(stats.select("n").scalar() / 2)
    near = timings.where(value.between(low, high)).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    part = F.coalesce(F.floor((F.col("value") - low) / F.nullif(high - low, F.lit(0.0)) * PARTS), F.lit(0))
    near = near.withColumn("part", part)
    parts = near.groupBy("part").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.orderBy("part")) + below
    found = parts.select("part", "n", upto.alias("upto")).where(F.col("upto") > middle).agg(
        F.min_by(F.struct("part", (F.col("upto") - F.col("n")).alias("before")), "part").alias("found")
    )
    inside = near.where(F.col("part") == found.select("found.part").scalar())
    upto = F.sum("n").over(Window.orderBy("value")) + found.select("found.before").scalar()
    median = inside.select("value", upto.alias("upto")).where(F.col("upto") > middle).agg(F.min("value"))
    mean = F.col("total") / F.col("n")
    return stats.select(
        F.bround("total", 1).alias("total_s"),
        F.bround(mean, 2).alias("mean_s"),
        F.bround(median.scalar(), 2).alias("median_s"),
        F.bround("largest", 2).alias("max_s"),
        F.bround(mean * estimate_for / 3600, 1).alias("estimated_h"),
    )


def coalesce_report(clips: DataFrame) -> DataFrame:
    """Per split: clips, actions before and after merging, share removed, clips left empty."""
    sums = clips.groupBy("split").agg(
        F.count(F.lit(1)).alias("clips"),
        F.sum("n_before").alias("before"),
        F.sum("n_after").alias("after"),
        F.count_if(F.col("n_after") == 0).alias("empty_clips"),
    )
    kept = F.col("after") / F.greatest("before", F.lit(1))
    return sums.withColumn("removed_pct", 100 * (1 - kept))

"""Black frames and the renumbering of what is kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A channel below this is dark; this share of dark pixels makes a frame black.
DARK = 15
BLACK_THRESHOLD = 0.95


@F.pandas_udf(T.DoubleType())
def _dark_share(data: pd.Series, channels: pd.Series) -> pd.Series:
    """Share of pixels whose channels are all dark; pixels are dense bytes of n channels."""

    def share(raw: bytes, n: int) -> float:
        return float((np.frombuffer(raw, np.uint8).reshape(-1, n) < DARK).all(axis=1).mean())

    return pd.Series([share(raw, n) for raw, n in zip(data, channels)], dtype="float64")


def black_fraction(data: Column, channels: Column) -> Column:
    """Share of near-black pixels of a decoded image."""
    return _dark_share(data, channels)


def black_fractions(frames: DataFrame) -> DataFrame:
    """Reduce frames to one number each, so that no pixel reaches a shuffle."""
    return frames.withColumn("black_fraction", black_fraction(F.col("data"), F.col("n_channels"))).drop(
        "data", "n_channels"
    )


def drop_black_frames(frames: DataFrame, threshold: float = BLACK_THRESHOLD) -> DataFrame:
    """Drop frames whose near-black share exceeds the threshold; 1 or more keeps all."""
    if threshold >= 1.0:
        return frames
    return frames.where(F.col("black_fraction") <= threshold)


def renumber(kept: DataFrame, total: str | None = None) -> DataFrame:
    """Add ``new_idx``: kept frames counted from 0; ``total`` names a column for their number.

    A recording has one row per frame, so a window over it is bounded by the video's length.
    """
    whole = Window.partitionBy("recording_id")
    numbered = kept.withColumn("new_idx", F.row_number().over(whole.orderBy("frame_idx")) - 1)
    return numbered.withColumn(total, F.count(F.lit(1)).over(whole).cast("int")) if total else numbered


def reindex_events(events: DataFrame, kept: DataFrame, total: str | None = None) -> DataFrame:
    """Move events to the new numbers; events on dropped frames vanish. ``total`` names a column for
    the number of kept frames, counted in the pass that numbers them."""
    columns = ["recording_id", "frame_idx", "new_idx", *([total] if total else [])]
    moved = events.join(renumber(kept, total).select(*columns), ["recording_id", "frame_idx"])
    return moved.withColumn("frame_idx", F.col("new_idx")).drop("new_idx")


def frame_counts(kept: DataFrame) -> DataFrame:
    return kept.groupBy("recording_id").agg(F.count(F.lit(1)).cast("int").alias("num_frames"))

"""Scroll gestures, and the merging of repeated scrolls and clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .scan import HOT_ROWS, carry, split_hot


def scroll_per_frame(framed: DataFrame) -> DataFrame:
    """Sum of the scroll movement of each frame that has any."""
    moved = framed.where(F.col("etype") == "MouseScroll").withColumn(
        "delta", names.scroll_delta(F.col("dx"), F.col("dy"))
    )
    return (
        moved.where(F.col("delta").isNotNull())
        .groupBy("recording_id", "frame")
        .agg(F.sum("delta").alias("delta"))
    )


def scroll_gestures(per_frame: DataFrame) -> DataFrame:
    """Net direction of each run of adjacent scroll frames, at its first frame.

    The input has one row per frame at most, so a window over a recording is bounded by the
    length of the video and not by the size of its log.
    """
    window = Window.partitionBy("recording_id").orderBy("frame")
    starts = per_frame.withColumn(
        "starts", F.coalesce(F.col("frame") - F.lag("frame").over(window) > 1, F.lit(True))
    )
    runs = starts.withColumn(
        "first_frame", F.last(F.when(F.col("starts"), F.col("frame")), True).over(window)
    )
    net = runs.groupBy("recording_id", "first_frame").agg(F.sum("delta").alias("delta"))
    return net.where("delta <> 0").select(
        "recording_id",
        F.col("first_frame").alias("frame_idx"),
        F.lit("MouseScroll").alias("type"),
        names.scroll_direction(F.col("delta")).alias("details"),
    )


def coalesce_scroll_list(
    actions: DataFrame, group: list[str], frame: str = "frame_idx", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Merge scrolls that follow each other in the list (``pos``), same way, frames adjacent.

    Any other action in between ends a run. The first of a run stays.
    """
    sliced = split_hot(actions, group, F.shiftright("pos", 16), ("pos",), hot_rows)
    here = F.struct("type", "details", F.col(frame).alias("frame"))
    scanned = carry(sliced, group, ["pos"], {"_prev": here}, dense=True)
    prev = F.col("_prev")
    merges = (
        (F.col("type") == "MouseScroll")
        & (prev["type"] == "MouseScroll")
        & prev["details"].eqNullSafe(F.col("details"))
        & (F.col(frame) <= prev["frame"] + 1)
    )
    return scanned.where(~F.coalesce(merges, F.lit(False))).select(*actions.columns)


def mark_repeats(
    actions: DataFrame,
    group: list[str],
    frame: str,
    gap: int = 1,
    details: str = "details",
    order: str = "pos",
    finer: tuple[str, ...] = ("pos",),
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add ``kept``: false for scrolls, and clicks, that repeat the one before within ``gap`` frames.

    Scrolls are compared with scrolls and clicks with clicks; other actions neither merge nor
    separate. ``order`` names what orders the actions of one frame, and ``finer`` numbers that
    never decrease along it, as in ``split_hot``, which ``counted`` is for too.

    One pass over all actions: those that take no part are dealt by their frames, so that they
    make up no large group.
    """
    merging = F.coalesce(F.col("type").isin("MouseScroll", "MouseClick"), F.lit(False))
    apart = F.when(merging, F.lit(None)).otherwise(F.struct("type", frame))
    sizes = actions.where(merging) if counted is None else counted
    sliced = split_hot(actions, [*group, "type"], frame, finer, hot_rows, sizes).withColumn("_apart", F.hash(apart))
    here = F.struct(F.col(frame).alias("frame"), F.col(details).alias("details"))
    scanned = carry(sliced, [*group, "type", "_apart"], [frame, order], {"_prev": here}, dense=True)
    repeats = _repeats(F.col("_prev"), frame, details, gap)
    return scanned.select(*actions.columns, (~(merging & repeats)).alias("kept"))


def coalesce_repeats(
    actions: DataFrame,
    group: list[str],
    frame: str,
    gap: int = 1,
    details: str = "details",
    order: str = "pos",
    finer: tuple[str, ...] = ("pos",),
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Merge what ``mark_repeats`` finds; the first stays."""
    marked = mark_repeats(actions, group, frame, gap, details, order, finer, hot_rows, counted)
    return marked.where("kept").drop("kept")


def _repeats(prev: Column, frame: str, details: str, gap: int) -> Column:
    near = F.col(frame) - prev["frame"] <= gap
    return F.coalesce(near & prev["details"].eqNullSafe(F.col(details)), F.lit(False))


def mark_gt(
    truth: DataFrame,
    group: list[str],
    gap: int = 1,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add ``kept`` to scoring actions; scrolls without direction go after merging."""
    marked = mark_repeats(truth, group, "frame", gap, "detail", "seq", ("seq.ts_us", "seq.ord"), hot_rows, counted)
    aimless = (F.col("type") == "MouseScroll") & (F.coalesce("detail", F.lit("")) == "")
    return marked.withColumn("kept", F.col("kept") & ~F.coalesce(aimless, F.lit(False)))


def coalesce_gt(
    truth: DataFrame,
    group: list[str],
    gap: int = 1,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """The scoring actions that ``mark_gt`` keeps."""
    return mark_gt(truth, group, gap, hot_rows, counted).where("kept").drop("kept")

"""Whole logs to actions: the training form and the truth used in scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.frames import _int
from ..operators import gestures, spans
from ..operators.scan import HOT_ROWS, split_hot


def framed_spans(
    log: DataFrame, fps: int | str, num_frames: int | str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Closed key and button spans of every recording."""
    rows = spans.state_rows(spans.in_frames(log, fps, num_frames))
    rows = split_hot(rows, ["recording_id"], hot_rows=hot_rows, counted=log)
    keep = [num_frames] if isinstance(num_frames, str) else []
    return spans.close_open_spans(spans.hold_spans(rows, keep), _int(num_frames) - 1)


def parse_keylog(
    log: DataFrame,
    fps: int | str = 10,
    num_frames: int | str = "num_frames",
    action_types: str = "all",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Actions per frame: ``recording_id, frame_idx, type, details, seq``.

    ``seq`` orders actions of one frame and type.

    Only the branches that the selected action types need are part of the plan.
    """
    types = names.selected_types(action_types)
    held = framed_spans(log, fps, num_frames, hot_rows)
    if "MouseClick" in types:
        out = spans.span_actions(held, num_frames)
    else:
        out = spans.explode_spans(held, num_frames)
    if "MouseScroll" in types:
        moved = gestures.scroll_per_frame(spans.in_frames(log, fps, num_frames))
        # A frame starts one gesture at most, so gestures need no order among themselves.
        zero = F.lit(0).cast("bigint")
        found = gestures.scroll_gestures(moved).withColumn("seq", spans.instant_seq(zero, zero))
        out = out.unionByName(found)
    return out


def gt_actions(log: DataFrame, fps: int | str = 2, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Truth actions of clips that start at ``start_s``: ``recording_id, frame, type, detail, seq``.

    Every scroll tick counts, in its vertical direction; spans that nothing ends run to the
    last frame seen in the log.
    """
    framed = spans.in_rounded_frames(log, fps)
    rows = split_hot(spans.state_rows(framed), ["recording_id"], hot_rows=hot_rows, counted=log)
    last = spans.last_frame_of_log(framed)
    held = spans.close_open_spans(spans.hold_spans(rows), last)
    # A merged scroll names its direction; a raw one has its vertical movement.
    direction = names.scroll_direction(F.col("dy"))
    if "direction" in framed.columns:
        direction = F.coalesce(F.nullif("direction", F.lit("")), direction)
    scrolled = framed.where(F.col("etype") == "MouseScroll").select(
        "recording_id",
        F.col("frame").alias("frame_idx"),
        F.lit("MouseScroll").alias("type"),
        direction.alias("details"),
        spans.instant_seq(F.col("ts_us"), F.col("ord")).alias("seq"),
    )
    out = spans.span_actions(held).unionByName(scrolled.where(F.col("details").isNotNull()))
    return out.select(
        "recording_id",
        F.col("frame_idx").alias("frame"),
        "type",
        F.col("details").alias("detail"),
        "seq",
    )


def merging_rows(log: DataFrame, fps: int | str = 2) -> DataFrame:
    """The log rows that truth scrolls and clicks come from, to count them without the state."""
    etype = F.col("etype")
    kind = F.when(etype == "MouseScroll", "MouseScroll").when(etype == "MousePress", "MouseClick")
    rows = spans.in_rounded_frames(log, fps).withColumn("type", kind)
    seq = spans.instant_seq(F.col("ts_us"), F.col("ord"))
    return rows.where(F.col("type").isNotNull()).select("recording_id", "type", "frame", seq.alias("seq"))

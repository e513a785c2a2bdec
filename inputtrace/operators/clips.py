"""Sliding clips, their actions, and the change of frame rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frames as fn
from ..functions.names import normalize_training_details

CLIP = ["recording_id", "chunk"]


def clip_windows(recordings: DataFrame, length: int = 30, stride: int = 15) -> DataFrame:
    """One row per clip of each recording: ``chunk, start_frame, num_frames``."""
    last = fn.clip_count(F.col("num_frames"), length, stride) - 1
    clips = recordings.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk") * stride
    return clips.withColumns(
        {"start_frame": start, "num_frames": F.least(F.lit(length), F.col("num_frames") - start)}
    )


def chunk_events(events: DataFrame, length: int = 30, stride: int = 15) -> DataFrame:
    """Copy every event into each clip that holds its frame, with its frame inside the clip.

    The clips of a frame follow from the frame number and ``num_frames``, so no range join is
    needed. Events in a tail that fills no clip vanish.
    """
    frame, n = F.col("frame_idx"), F.col("num_frames")
    first = F.greatest(F.lit(0), F.ceil((frame - length + 1) / stride)).cast("int")
    last = F.least(F.floor(frame / stride).cast("int"), fn.clip_count(n, length, stride) - 1)
    # A sequence whose end is below its start counts down, hence the condition.
    chunks = F.when(first <= last, F.sequence(first, last))
    placed = events.withColumn("chunk", F.explode(chunks))
    return placed.withColumn("frame_idx", frame - F.col("chunk") * stride).drop("num_frames")


def clip_action_counts(clips: DataFrame, events: DataFrame, clip: list[str] = CLIP) -> DataFrame:
    """``n_actions`` of every clip, also of those without any."""
    counts = events.groupBy(*clip).agg(F.count(F.lit(1)).alias("n_actions"))
    return clips.join(counts, clip, "left").na.fill({"n_actions": 0})


def labelled(events: DataFrame) -> DataFrame:
    """Training form: frame numbers become labels."""
    return events.withColumn("frame", fn.frame_label(F.col("frame_idx"))).drop("frame_idx")


def normalize_training_actions(actions: DataFrame) -> DataFrame:
    """Drop keys nobody can see and apply the training spellings."""
    seen = actions.where(~F.contains(F.col("details"), F.lit("Unknown(")))
    return seen.withColumn("details", normalize_training_details(F.col("details")))


def drop_empty_clips(clips: DataFrame) -> DataFrame:
    return clips.where(F.col("n_actions") > 0)


def selected_frames(clips: DataFrame, src_fps: int = 5, dst_fps: int = 2) -> DataFrame:
    """The frames a clip keeps at the new rate: ``new_frame, source_frame``."""
    count = fn.resampled_count(F.col("num_frames"), src_fps, dst_fps)
    kept = clips.where("num_frames > 0").withColumn("new_frame", F.explode(F.sequence(F.lit(0), count - 1)))
    source = fn.resampled_source(F.col("new_frame"), F.col("num_frames"), src_fps, dst_fps)
    return kept.withColumn("source_frame", source)


def remap_actions(actions: DataFrame, src_fps: int = 5, dst_fps: int = 2) -> DataFrame:
    """Move labelled actions to the new rate; ``num_frames`` is the clip's old length."""
    count = fn.resampled_count(F.col("num_frames"), src_fps, dst_fps)
    frame = fn.resampled_frame(fn.frame_after_first_char(F.col("frame")), count, src_fps, dst_fps)
    return actions.withColumns({"frame": fn.frame_label(frame), "num_frames": count})


def keep_existing_clips(clips: DataFrame, frames: DataFrame, key: list[str]) -> DataFrame:
    """Clips of which at least one frame file exists."""
    return clips.join(frames.select(*key), key, "left_semi")


def nest_actions(
    clips: DataFrame, actions: DataFrame, clip: list[str] = CLIP, order: tuple[str, ...] = ("pos",)
) -> DataFrame:
    """Clip rows with their actions as an array in frame order, ``order`` deciding ties."""
    ties = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    placed = F.struct(fn.frame_of_label(F.col("frame")).alias("f"), *ties, "frame", "type", "details")
    listed = actions.groupBy(*clip).agg(F.array_sort(F.collect_list(placed)).alias("_listed"))
    bare = F.transform("_listed", lambda a: F.struct(a["frame"], a["type"], a["details"]))
    empty = F.array().cast("array<struct<frame:string,type:string,details:string>>")
    joined = clips.join(listed, clip, "left")
    return joined.withColumn("actions", F.coalesce(bare, empty)).drop("_listed")

"""Clips to training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.frames import frame_label
from ..functions.names import normalize_training_details


def frame_paths(clip_dir: Column, frames: Column, suffix: str = ".jpg") -> Column:
    """Paths of a clip's frames in order."""
    numbers = F.when(frames > 0, F.sequence(F.lit(0), frames - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.concat(clip_dir, F.lit("/"), frame_label(i), F.lit(suffix)))


def normalized(actions: Column) -> Column:
    """``normalize_training_actions`` on a clip's array."""
    seen = F.filter(actions, lambda a: ~F.contains(a["details"], F.lit("Unknown(")))
    return F.transform(
        seen,
        lambda a: F.struct(
            a["frame"].alias("frame"),
            a["type"].alias("type"),
            normalize_training_details(a["details"]).alias("details"),
        ),
    )


def sft_examples(clips: DataFrame, video_mode: str = "video", interleave_labels: bool = False) -> DataFrame:
    """Add ``prompt``, ``target`` and ``messages`` to clips with nested actions."""
    spelled = clips.withColumn("actions", normalized(F.col("actions")))
    written = spelled.withColumns(
        {
            "prompt": text.build_prompt(F.col("fps"), F.col("num_frames")),
            "target": text.target_json(F.col("actions")),
        }
    )
    shown = frame_paths(F.col("clip_dir"), F.col("num_frames"))
    messages = text.build_messages(
        shown, F.col("prompt"), F.col("target"), F.col("fps"), video_mode, interleave_labels
    )
    return written.withColumn("messages", messages)

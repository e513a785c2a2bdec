"""Whole jobs between folders: recordings to a clip index, evaluation clips to scores."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_response
from ..operators import frames as FR
from ..operators import sampling
from ..operators.reports import timing_stats
from ..operators.scan import HOT_ROWS
from ..session import scratch_path
from ..sources import files, schemas
from ..sources.keylog import kept_apart, tag_keylogs
from .training import score_results, training_clips

RECORDING_NAME = r"([^/]*)\.mp4$"


def run_metadata(
    recordings: DataFrame,
    settings: dict[str, Any],
    total_clips: int,
    with_clips: int,
    timings: DataFrame | None = None,
    seconds: float | None = None,
) -> DataFrame:
    """One row of ``schemas.METADATA``: the settings of a run, what it made, and its timing.

    ``recordings`` lists all recordings with their split, ``with_clips`` says how many of them have a
    clip. ``timings`` has the ``seconds`` of each recording. Spark works on all recordings at once, so
    without it only the whole time and its mean are known. Settings not given are null.
    """
    kinds = dict(column.split(" ") for column in schemas.METADATA.split(", "))
    unknown = set(settings) - set(kinds)
    if unknown:
        raise ValueError(f"no such settings: {sorted(unknown)}")
    counts = recordings.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("split") == "train").alias("train_recordings"),
        F.count_if(F.col("split") == "val").alias("val_recordings"),
    )
    if timings is not None:
        stats = timing_stats(timings, "seconds")
        timing = stats.select(F.struct("total_s", "mean_s", "median_s", "max_s")).scalar()
    else:
        total, none = F.lit(seconds).cast("double"), F.lit(None).cast("double")
        timing = F.struct(F.bround(total, 1), F.bround(total / F.nullif("n", F.lit(0)), 2), none, none)
    made = {
        "total_clips": F.lit(total_clips),
        "num_failed_recordings": F.col("n") - with_clips,
        "train_recordings": F.col("train_recordings"),
        "val_recordings": F.col("val_recordings"),
        "timing": timing,
    }
    values = {name: made.get(name, F.lit(settings.get(name))) for name in kinds}
    return counts.select(*[values[name].cast(kind).alias(name) for name, kind in kinds.items()])


def write_training_index(
    clips: DataFrame,
    recordings: DataFrame,
    root: str,
    settings: dict[str, Any],
    timings: DataFrame | None = None,
) -> DataFrame:
    """Write the clip index and, in ``metadata`` beside it, one row about the run, which is returned.

    ``clips`` are those of ``training_clips``. They are counted while they are written, so the plan
    behind them runs once; ``recordings`` lists all recordings with their split.
    """
    seen, start = Observation(), time.monotonic()
    first = F.count_if("is_first").alias("with_clips")
    files.write_clip_index(clips.observe(seen, F.count(F.lit(1)).alias("total_clips"), first), root)
    found = seen.get
    row = run_metadata(
        recordings, settings, found.get("total_clips", 0), found.get("with_clips", 0), timings, time.monotonic() - start
    )
    files.write_metadata(row, f"{root}/metadata")
    return clips.sparkSession.read.schema(schemas.METADATA).json(f"{root}/metadata")


def prepare_recordings(
    spark: SparkSession,
    root: str,
    frames: str,
    out: str,
    max_recordings: int = 0,
    fps: int = 10,
    black_threshold: float = FR.BLACK_THRESHOLD,
    clip_length: int = 30,
    clip_stride: int = 15,
    min_actions: int = 1,
    keep_empty_ratio: float = 0.05,
    action_types: str = "keyboard,click,scroll",
    train_ratio: float = 0.85,
    seed: int = 42,
    hot_rows: int = HOT_ROWS,
    resolution: str | None = None,
    top_bar_fraction: float | None = None,
    label_frames: bool | None = None,
) -> DataFrame:
    """Videos and logs under ``root`` to a clip index with its metadata under ``out``.

    The name of a video without its ending is the ``recording_id`` throughout. Its frames lie in
    ``frames``, in a folder ``recording_id=<name>`` of images. A recording whose log cannot be read, or
    that has no frames, has no clips and counts as failed; bad entries and broken images are left out.
    ``resolution``, ``top_bar_fraction`` and ``label_frames`` say how the frames were made. Logs and
    images are opened once: typed rows and shares of dark pixels are kept in the shared folder.
    """
    found = files.find_recordings(spark, root)
    found = found.withColumn("recording_id", F.regexp_extract("video_path", RECORDING_NAME, 1))
    listed = sampling.first_recordings(found, "video_path", max_recordings)
    listed.write.parquet(path := scratch_path(spark, "recordings"))
    listed = spark.read.schema(listed.schema).parquet(path)

    tagged = tag_keylogs(listed.select("recording_id", F.col("keylog_path").alias("path")))
    log, bad = kept_apart(tagged, scratch_path(spark, "log"))
    unreadable = bad.where("ord is null").select("recording_id").distinct()

    shares = FR.black_fractions(files.read_frames(spark, frames)).select(
        F.col("recording_id").cast("string"), "frame_idx", "black_fraction"
    )
    shares.join(listed, "recording_id", "left_semi").write.parquet(path := scratch_path(spark, "frames"))
    shares = spark.read.schema(shares.schema).parquet(path).join(unreadable, "recording_id", "left_anti")

    clips = training_clips(
        log, shares, fps, black_threshold, clip_length, clip_stride, min_actions, keep_empty_ratio,
        action_types, train_ratio, seed, hot_rows, listed,
    )
    settings = dict(
        input_dir=root, fps=fps, resolution=resolution, top_bar_fraction=top_bar_fraction,
        black_threshold=black_threshold, clip_length=clip_length, clip_stride=clip_stride,
        action_types=action_types, label_frames=label_frames, seed=seed,
    )
    split = sampling.split_recordings(listed.select("recording_id").distinct(), "recording_id", train_ratio, seed)
    return write_training_index(clips, split, out, settings)


def score_eval_clips(
    clips: DataFrame, answers: DataFrame, fps: int, tolerance: int = 2, coalesce: bool = True, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Scores of answers to evaluation clips (``read_eval_clips``) overall, per type and per clip.

    ``answers`` has the text ``response`` to each ``mp4_path``; clips without one are not scored. The
    overall row holds the summed counts.
    """
    answered = clips.join(answers.select("mp4_path", "response"), "mp4_path").select(
        F.lit(None).cast("string").alias("document"), F.col("mp4_path").alias("clip_index"), "clip_name", "tag",
        "start_s", F.lit(fps).alias("fps"), F.col("actions").alias("ground_truth"),
        parse_response(F.col("response")).alias("predictions"),
    )
    scores = score_results(answered, tolerance, coalesce, hot_rows)
    return scores.drop("document").withColumnRenamed("clip_index", "mp4_path")

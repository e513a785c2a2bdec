"""Recordings to training clips, and stored results to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import short_clip_id
from ..operators import clips as C
from ..operators import frames as FR
from ..operators import sampling, scoring
from ..operators.gestures import coalesce_gt
from ..operators.predictions import filter_predictions
from ..operators.scan import HOT_ROWS
from ..sources.files import predicted_actions, truth_entries
from ..sources.keylog import parse_entries
from .keylog import gt_actions, merging_rows, parse_keylog


def training_clips(
    log: DataFrame,
    frames: DataFrame,
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
    recordings: DataFrame | None = None,
) -> DataFrame:
    """Clip index rows: ``clip_id, clip_dir, num_frames, fps, actions, split``, their keys, and
    ``is_first``, true for one clip of each recording, so that recordings can be counted in passing.

    ``log`` holds typed entries, ``frames`` one row per frame with its ``black_fraction``, both
    by ``recording_id``, the name of the video. ``recordings`` lists them all; else those with
    a log or frames count. A recording without frames yields no clips and one with an empty log
    clips without actions; both take part in the split.
    """
    if recordings is None:
        recordings = log.select("recording_id").union(frames.select("recording_id"))
    split = sampling.split_recordings(recordings.select("recording_id").distinct(), "recording_id", train_ratio, seed)
    timed = log.join(FR.frame_counts(frames), "recording_id")
    actions = parse_keylog(timed, fps, "num_frames", action_types, hot_rows)

    kept = FR.drop_black_frames(frames, black_threshold)
    lengths = FR.frame_counts(kept)
    moved = FR.reindex_events(actions.drop("num_frames"), kept, "num_frames")
    placed = C.chunk_events(moved, clip_length, clip_stride)
    windows = C.clip_action_counts(C.clip_windows(lengths, clip_length, clip_stride), placed)
    named = windows.withColumn("clip_id", short_clip_id(F.col("recording_id"), F.col("chunk")))
    # Short names may collide; the choice is made by the full one.
    named = named.withColumn("_key", F.concat_ws("_", *C.CLIP))
    chosen = sampling.sample_negatives(named, "_key", "n_actions", min_actions, keep_empty_ratio, seed).drop("_key")
    # A window over the clips of a recording is bounded by the length of the video.
    place = F.row_number().over(Window.partitionBy("recording_id").orderBy("chunk"))
    chosen = chosen.withColumn("is_first", place == 1)
    nested = C.nest_actions(chosen, C.labelled(placed), order=("type", "seq"))
    return nested.join(split, "recording_id").select(
        *C.CLIP, "clip_id", F.concat_ws("/", "split", "clip_id").alias("clip_dir"), "num_frames",
        F.lit(fps).alias("fps"), "actions", "split", "is_first",
    )


def score_results(
    results: DataFrame, tolerance: int = 2, coalesce: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Scores of stored results (``read_results``) overall, per type and per clip of a document.

    Clips are told apart by ``document`` and ``clip_index``; the rows of a clip have both, its
    ``clip_name`` and its ``tag``."""
    keyed = results.withColumn("recording_id", F.struct("document", "clip_index"))
    log = parse_entries(truth_entries(keyed, ["recording_id"]))
    truth = gt_actions(log, "fps", hot_rows)
    if coalesce:
        truth = coalesce_gt(truth, ["recording_id"], hot_rows=hot_rows, counted=merging_rows(log, "fps"))
    said = filter_predictions(predicted_actions(keyed, ["recording_id"])).drop("pos")
    scores = scoring.score(truth, said, keyed, ["recording_id"], tolerance)
    named = keyed.select("recording_id", "clip_name", "tag").dropDuplicates(["recording_id"])
    return scores.join(named, "recording_id", "left").select(
        "level", F.col("recording_id.document").alias("document"), F.col("recording_id.clip_index").alias("clip_index"),
        "clip_name", "tag", *[c for c in scores.columns if c not in ("level", "recording_id")],
    )

"""Scores overall, per type and per clip, and under several settings at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import with_prf
from .gestures import mark_gt
from .matching import match_frames, match_settings, outcome_counts
from .scan import HOT_ROWS

COUNTS = ["gt_count", "pred_count", "tp", "fp", "fn"]


def score_rollup(counts: DataFrame, clips: DataFrame, clip: list[str], within: Sequence[str] = ()) -> DataFrame:
    """One long table of scores: ``level`` overall, type or clip, each for itself ``within`` a document.

    ``counts`` are outcome counts per clip and type. A clip with neither truth nor predictions
    appears at clip level with zeros, a type that never occurs does not appear.
    """
    within = list(within)
    # A zero row without type stands for each clip; it adds nothing to the sums.
    zero = F.lit(0).cast("bigint")
    rows = counts.select(*within, *clip, "type", *COUNTS).unionByName(
        clips.select(*within, *clip).distinct().select(*within, *clip, F.lit(None).cast("string").alias("type"), *[zero.alias(c) for c in COUNTS])
    )
    clip_cols, outer = [F.col(c) for c in clip], [F.col(c) for c in within]
    levels = [outer, [*outer, F.col("type")], [*outer, *clip_cols]]
    sets = rows.groupingSets(levels, *outer, F.col("type"), *clip_cols).agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.grouping("type").alias("_no_type"),
        F.grouping(clip[0]).alias("_no_clip"),
    )
    level = (
        F.when(F.col("_no_type") == 0, "type").when(F.col("_no_clip") == 0, "clip").otherwise("overall")
    )
    named = sets.withColumn("level", level).where((F.col("level") != "type") | F.col("type").isNotNull())
    return with_prf(named).select("level", *within, *clip, "type", *COUNTS, "precision", "recall", "f1")


def nested_summary(counts: DataFrame, clips: DataFrame, document: list[str], clip: list[str]) -> DataFrame:
    """One row per document: ``overall`` scores, ``per_type`` scores by type, and its ``clips`` in order of
    ``clip``, which tells them apart within the document. Documents follow from ``clips``.

    Scores are reduced to one row per type and clip before a document's row is put together."""
    scores = score_rollup(counts, clips, clip, document)
    fields = ["tp", "fp", "fn", "precision", "recall", "f1"]
    entry = F.struct("type", F.struct(*fields))
    return scores.groupBy(*document).agg(
        F.first(F.when(F.col("level") == "overall", F.struct(*fields)), ignorenulls=True).alias("overall"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("level") == "type", entry)))).alias("per_type"),
        F.sort_array(F.collect_list(F.when(F.col("level") == "clip", F.struct(*clip, *fields)))).alias("clips"),
    )


def score(
    truth: DataFrame, preds: DataFrame, clips: DataFrame, clip: list[str], tolerance: int = 2
) -> DataFrame:
    """Match and roll up in one plan."""
    solved = match_frames(truth, preds, clip, tolerance)
    return score_rollup(outcome_counts(solved, [*clip, "type"]), clips, clip)


def micro(counts: DataFrame) -> DataFrame:
    """One row: summed counts, then precision, recall and f1."""
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return with_prf(sums)


def macro(per_clip: DataFrame) -> DataFrame:
    """One row: means over clips, 0 without clips."""
    return per_clip.agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")]
    )


def rescore_sweep(
    truth: DataFrame,
    preds: DataFrame,
    clip: list[str],
    tolerances: list[int],
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Overall counts and scores for every tolerance, with and without coalesced truth.

    ``truth`` needs ``seq`` and is read once. All settings share one matching job. ``counted`` as in ``split_hot``.
    """
    marked = mark_gt(truth, clip, hot_rows=hot_rows, counted=counted)
    solved = match_settings(marked, preds, clip, tolerances)
    return with_prf(outcome_counts(solved, ["tolerance", "coalesce"]))


def score_report(scores: DataFrame, clip: list[str]) -> DataFrame:
    """The printed report: rounded half to even, overall first, then types, then clips."""
    place = F.when(F.col("level") == "overall", 0).when(F.col("level") == "type", 1).otherwise(2)
    shown = {c: F.bround(c, 4) for c in ("precision", "recall", "f1")}
    short = {f"{c}_2": F.bround(c, 2) for c in ("precision", "recall", "f1")}
    return scores.withColumns({**short, **shown}).orderBy(place, "type", *clip)

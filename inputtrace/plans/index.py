"""Clip indexes to clip indexes. A clip line holds its own actions, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames as fn


def _kept(actions: Column, kind: str, rank: int, gap: int) -> Column:
    """Actions of one kind in frame order without those that repeat the one before."""

    def repeats(a: Column, before: Column) -> Column:
        return (a["f"] - before["f"] <= gap) & a["details"].eqNullSafe(before["details"])

    placed = F.transform(
        actions,
        lambda a, i: F.struct(
            fn.frame_of_label(a["frame"]).alias("f"), F.lit(rank).alias("rank"), i.alias("at"),
            a["frame"].alias("frame"), a["type"].alias("type"), a["details"].alias("details"),
        ),
    )
    own = F.array_sort(F.filter(placed, lambda a: _is(a, kind)))
    if not kind:
        return own
    # A one-element array binds the sorted list, in which each action looks back.
    first = F.transform(
        F.array(own),
        lambda s: F.filter(s, lambda a, i: (i == 0) | ~repeats(a, F.get(s, i - 1))),
    )
    return F.element_at(first, 1)


def _is(a: Column, kind: str) -> Column:
    return a["type"] == kind if kind else ~a["type"].isin("MouseScroll", "MouseClick")


def coalesce_actions(actions: Column, gap: int = 1) -> Column:
    """A clip's actions with repeated scrolls and clicks merged, in frame order.

    Actions of one frame come as others, scrolls, clicks.
    """
    kinds = ("", "MouseScroll", "MouseClick")
    merged = F.array_sort(F.concat(*[_kept(actions, kind, rank, gap) for rank, kind in enumerate(kinds)]))
    return F.transform(merged, lambda a: F.struct(a["frame"].alias("frame"), a["type"].alias("type"), a["details"].alias("details")))


def coalesce_index(clips: DataFrame, gap: int = 1) -> DataFrame:
    """Clips with merged actions; ``n_before`` and ``n_after`` count them.

    ``coalesce_report`` sums the counts up; ``drop_empty`` removes what is left empty.
    """
    merged = clips.withColumns(
        {"n_before": F.size("actions"), "actions": coalesce_actions(F.col("actions"), gap)}
    )
    return merged.withColumn("n_after", F.size("actions"))


def drop_empty(clips: DataFrame) -> DataFrame:
    return clips.where(F.size("actions") > 0)


def subsample_index(clips: DataFrame, src_fps: int = 5, dst_fps: int = 2) -> DataFrame:
    """Clips at the new frame rate; ``selected_frames`` lists the frames to keep for each."""
    count = fn.resampled_count(F.col("num_frames"), src_fps, dst_fps)
    moved = F.transform(
        "actions",
        lambda a: F.struct(
            fn.frame_label(
                fn.resampled_frame(fn.frame_after_first_char(a["frame"]), count, src_fps, dst_fps)
            ).alias("frame"),
            a["type"].alias("type"),
            a["details"].alias("details"),
        ),
    )
    return clips.withColumns({"actions": moved, "num_frames": count, "fps": F.lit(dst_fps)})

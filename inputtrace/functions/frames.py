"""Frame numbers, frame labels and frame-rate arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(value: int | str | Column) -> Column:
    """A setting given as a number, a column name or a column."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def _div(numerator: Column, denominator: int) -> Column:
    """Whole division of integers, towards zero."""
    whole = F.call_function("div", numerator.cast("bigint"), F.lit(denominator).cast("bigint"))
    return whole.cast("int")


def frame_floor(ts_us: Column, fps: int | str | Column) -> Column:
    """Frame of a log time: the one whose interval holds it (also below zero)."""
    return F.floor(ts_us * _int(fps) / F.lit(1000000)).cast("int")


def frame_round(ts_us: Column, start_s: Column, fps: int | str | Column) -> Column:
    """Nearest frame to a time relative to the clip start, halves to the even frame."""
    relative = ts_us.cast("double") - start_s.cast("double") * F.lit(1e6)
    return F.rint(relative / F.lit(1e6) * _int(fps)).cast("int")


def frame_label(frame: Column) -> Column:
    return F.format_string("F%02d", frame)


def frame_of_label(label: Column) -> Column:
    """Frame of a label in a clip index: every ``F`` removed."""
    return F.regexp_replace(label, "F", "").try_cast("int")


def frame_after_first_char(label: Column) -> Column:
    return F.substring(label, 2, 32).try_cast("int")


def frame_of_prediction(label: Column) -> Column:
    """Frame of a predicted label, -1 where it is not one."""
    digits = F.regexp_extract(label, r"^\s*[Ff]\s*([+-]?\d+)\s*$", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(-1))


def frame_from_digits(label: Column) -> Column:
    """Frame from all digits of a label; absent and empty labels are frame 0."""
    digits = F.regexp_replace(F.coalesce(label, F.lit("F00")), "[^0-9]", "")
    return F.when(label == "", F.lit(0)).otherwise(digits.try_cast("int"))


def resampled_count(frames: Column, src_fps: int, dst_fps: int) -> Column:
    """Number of frames a clip has at the new rate."""
    return _div((frames - 1) * dst_fps, src_fps) + 1


def resampled_source(new_frame: Column, frames: Column, src_fps: int, dst_fps: int) -> Column:
    """Old frame shown at a new frame: the nearest, halves up, never past the end."""
    nearest = _div(2 * new_frame * src_fps + dst_fps, 2 * dst_fps)
    return F.least(nearest, frames - 1)


def resampled_frame(frame: Column, new_count: Column, src_fps: int, dst_fps: int) -> Column:
    """New frame of an action at an old frame: the nearest, halves up, never past the end."""
    nearest = _div(2 * frame * dst_fps + src_fps, 2 * src_fps)
    return F.least(nearest, new_count - 1)


def clip_count(frames: Column, length: int, stride: int) -> Column:
    """Number of sliding clips over a recording; a short one still gives one."""
    return _div(F.greatest(F.lit(1), frames - length + 1) - 1, stride) + 1


# Fixed value: a session id, of which the first six digits are kept.
SESSION_ID = "([0-9a-f]{6})[0-9a-f-]+"


def short_clip_id(video_name: Column, chunk: Column) -> Column:
    """Display id of a clip: shortened recording name and clip number."""
    stem = F.replace(F.replace(video_name, F.lit(".mp4"), F.lit("")), F.lit("recording_"), F.lit("rec_"))
    short = F.regexp_replace(stem, SESSION_ID, "$1")
    return F.concat(short, F.format_string("_c%03d", chunk))

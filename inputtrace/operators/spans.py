"""From raw presses and releases to the spans for which keys and buttons are held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.frames import _int, frame_floor, frame_round
from .scan import SLICE, carry

ORDER = ["ts_us", "ord"]
# Later than any time in a log.
NEVER = 2**53


def in_frames(log: DataFrame, fps: int | str, num_frames: int | str) -> DataFrame:
    """Frame of every log row; rows outside the video are dropped before any state."""
    frame = frame_floor(F.col("ts_us"), fps)
    return log.withColumn("frame", frame).where(
        (F.col("frame") >= 0) & (F.col("frame") < _int(num_frames))
    )


def in_rounded_frames(log: DataFrame, fps: int | str) -> DataFrame:
    """Nearest frame relative to the clip start; rows before the clip are dropped."""
    frame = frame_round(F.col("ts_us"), F.col("start_s"), fps)
    return log.withColumn("frame", frame).where(F.col("frame") >= 0)


def _key() -> Column:
    raw = F.col("raw_key")
    typed = F.col("etype").isin("KeyPress", "KeyRelease") & (raw != "UNKNOWN")
    return F.when(typed, names.normalize_key(raw))


def _button() -> Column:
    clicked = F.col("etype").isin("MousePress", "MouseRelease")
    return F.when(clicked, names.valid_button(F.col("button")))


def _context_release() -> Column:
    return (F.col("etype") == "ContextChanged") & F.coalesce(F.col("uncaptured"), F.lit(False))


def state_rows(log: DataFrame) -> DataFrame:
    """The log rows that change state: valid presses and releases, and context releases."""
    typed = log.withColumns(
        {
            "key": _key(),
            "held_button": _button(),
            "pressed": F.col("etype").isin("KeyPress", "MousePress"),
            "releases_all": _context_release(),
        }
    )
    return typed.where(
        F.col("key").isNotNull() | F.col("held_button").isNotNull() | F.col("releases_all")
    )


def held_before(rows: DataFrame, modifiers=names.MODIFIERS) -> DataFrame:
    """Which modifiers are held before each row: ``held_cmd`` and so on, and its ``epoch``.

    The epoch is the place of the context release before the row, null before the first one;
    ``epoch_end`` is the place of the next one.
    """
    flags = {
        f"held_{m.lower()}": F.when(F.col("releases_all"), F.lit(False)).when(
            F.col("key") == m, F.col("pressed")
        )
        for m in modifiers
    }
    here = F.when(F.col("releases_all"), _place())
    scanned = carry(rows, ["recording_id"], ORDER, {**flags, "epoch": here}, {"epoch_end": here})
    return scanned.withColumns({name: F.coalesce(F.col(name), F.lit(False)) for name in flags})


def _place() -> Column:
    return F.struct("ts_us", "ord", "frame")


def with_devices(rows: DataFrame) -> DataFrame:
    """``device`` and ``name`` of what is pressed or released; none for context releases."""
    is_key = F.col("key").isNotNull()
    return rows.withColumns(
        {"device": F.when(is_key, "key").otherwise("button"), "name": F.coalesce("key", "held_button")}
    )


def hold_spans(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per span for which a key or button is held.

    ``released_frame`` is the frame of the release or of the context release that ends the
    span, and null where nothing ends it. The text is the one at the time of the press.
    ``seq`` orders spans as they end: what ends together, or never, in the order of pressing.
    ``keep`` names further columns of the press to pass on.
    """
    def presses(of: DataFrame) -> DataFrame:
        device = with_devices(of).where(~F.col("releases_all"))
        return device.where((F.col("device") == "button") | ~names.is_modifier(F.col("name")))

    # Two scans of the same rows: modifiers and context releases by recording, and each key or
    # button by itself. What a context release ends follows from the places of both.
    scanned = presses(held_before(rows, names.SHOWN_MODIFIERS))
    group = ["recording_id", "device", "name"]
    states = carry(
        scanned, group, ORDER,
        {"last": F.struct("ts_us", "ord", "pressed")}, {"release": F.when(~F.col("pressed"), _place())},
        source=presses(rows) if SLICE in rows.columns else None,
    )
    released = F.col("epoch").isNotNull() & (
        F.struct("last.ts_us", "last.ord") < F.struct("epoch.ts_us", "epoch.ord")
    )
    was_pressed = F.coalesce(F.col("last.pressed"), F.lit(False)) & ~released
    begun = states.where(F.col("pressed") & ~was_pressed)
    held = {m: F.col(f"held_{m.lower()}") for m in names.SHOWN_MODIFIERS}
    details = F.when(F.col("device") == "key", names.format_combo(F.col("name"), held)).otherwise(F.col("name"))
    end = F.least("release", "epoch_end")  # the earlier one; null only where both are
    seq = F.struct(
        F.coalesce(end["ts_us"], F.lit(NEVER)).alias("ts_us"),
        F.coalesce(end["ord"], F.lit(NEVER)).alias("ord"),
        F.col("ts_us").alias("pressed_us"),
        F.col("ord").alias("pressed_ord"),
    )
    return begun.select(
        "recording_id",
        "device",
        "name",
        details.alias("details"),
        F.col("frame").alias("start_frame"),
        end["frame"].alias("released_frame"),
        seq.alias("seq"),
        *(keep or []),
    )


def last_frame_of_log(framed: DataFrame) -> DataFrame:
    """Largest frame of any row of a recording, whatever its type."""
    return framed.groupBy("recording_id").agg(F.max("frame").alias("last_frame"))


def close_open_spans(spans: DataFrame, last_frame: int | str | DataFrame) -> DataFrame:
    """Give spans that nothing ends their end: a number, a column, or a table per recording."""
    if isinstance(last_frame, DataFrame):
        spans, last_frame = spans.join(last_frame, "recording_id", "left"), "last_frame"
    closed = spans.withColumn("end_frame", F.coalesce("released_frame", _int(last_frame)))
    return closed.drop("released_frame", "last_frame")


def instant_seq(ts_us: Column, ord_: Column) -> Column:
    """The ``seq`` of an action that is over at once."""
    return F.struct(
        ts_us.alias("ts_us"), ord_.alias("ord"), ts_us.alias("pressed_us"), ord_.alias("pressed_ord")
    )


def span_actions(spans: DataFrame, num_frames: int | str | None = None) -> DataFrame:
    """The actions of all spans in one pass: a KeyPress per held frame, a MouseClick per press.

    A key span inside one frame still counts there, and none runs past ``num_frames``. A
    dragged button is one click, at its first frame.
    """
    last = F.greatest("end_frame", F.col("start_frame") + 1) - 1
    if num_frames is not None:
        last = F.least(last, _int(num_frames) - 1)
    is_key = F.col("device") == "key"
    last = F.when(is_key, last).otherwise(F.col("start_frame"))
    return spans.select(
        "recording_id",
        F.explode(F.sequence("start_frame", last)).alias("frame_idx"),
        F.when(is_key, "KeyPress").otherwise("MouseClick").alias("type"),
        "details",
        "seq",
    )


def explode_spans(spans: DataFrame, num_frames: int | str | None = None) -> DataFrame:
    """One KeyPress per frame of each key span."""
    return span_actions(spans.where(F.col("device") == "key"), num_frames)


def clicks(spans: DataFrame) -> DataFrame:
    """One MouseClick per button span, at its first frame."""
    return span_actions(spans.where(F.col("device") == "button"))

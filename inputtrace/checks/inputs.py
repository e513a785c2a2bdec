"""Stand-in inputs: the given tables seen as logs, predictions, clips, frames and tokens.

Every input is a plain projection or filter of one table, so it grows with that table and adds
no shuffle of its own. ``FIXTURES.md`` describes the same views in SQL.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import frame_label
from ..operators.predictions import filter_predictions
from ..sources.paths import make_folder, open_path

FPS = 5
FRAMES = 150
CLIP_FRAMES = 25

# Raw names cycled through by the naming queries.
RAW_NAMES = [
    "Return", "Escape", "Backspace", "Space", "Tab", "ShiftLeft", "ShiftRight", "ControlLeft",
    "ControlRight", "Alt", "AltLeft", "AltRight", "AltGr", "MetaLeft", "MetaRight", "UpArrow",
    "DownArrow", "LeftArrow", "RightArrow", "CapsLock", "Delete", "Home", "End", "PageUp",
    "PageDown", "KeyA", "Keyz", "KeyAB", "Digit0", "Digit9", "Digit", "F1", "F12", "SemiColon",
    "UNKNOWN", "SomeWeirdKey",
]


SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", _k().alias("k"))


def keylog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw input log: one recording per user, times squeezed into 30 seconds."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)
    turn, k = F.col("event_id") % 16, F.col("k")
    etype = (
        F.when(turn <= 5, "KeyPress").when(turn <= 10, "KeyRelease").when(turn == 11, "MousePress")
        .when(turn == 12, "MouseRelease").when(turn <= 14, "MouseScroll")
        .when(k < 30, "ContextChanged").otherwise("MouseMove")
    )
    keys = ["KeyA", "KeyB", "KeyC", "ShiftLeft", "MetaLeft", "Return", "Digit1", "AltGr"]
    return events(spark, sf_dir).select(
        F.col("user_id").alias("recording_id"),
        F.col("event_id").alias("ord"),
        F.floor(micros / 86400).cast("bigint").alias("ts_us"),
        etype.alias("etype"),
        F.element_at(F.array(*[F.lit(name) for name in keys]), k % 8 + 1).alias("raw_key"),
        F.when(k % 3 == 0, "Right").otherwise("Left").alias("button"),
        (k % 3 - 1).cast("double").alias("dx"),
        (k % 5 - 2).cast("double").alias("dy"),
        (etype == "ContextChanged").alias("uncaptured"),
    )


def truth_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as truth of clips that start up to a second in."""
    start = F.lit(0.5) * (F.col("recording_id") % 3)
    return keylog(spark, sf_dir).withColumn("start_s", start)


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions near the logged actions, some of them invalid."""
    log = keylog(spark, sf_dir).where(
        F.col("etype").isin("KeyPress", "MousePress", "MouseScroll") & (F.col("ord") % 6 != 0)
    )
    frame = F.floor(F.col("ts_us") * FPS / 1000000).cast("int") + (F.col("ord") % 5).cast("int") - 2
    ord_, raw = F.col("ord"), F.col("raw_key")
    last = F.substring(raw, -1, 1)
    details = (
        F.when(F.col("etype") == "MousePress", F.col("button"))
        .when(
            F.col("etype") == "MouseScroll",
            F.when(ord_ % 9 == 0, "sideways").when(F.col("dy") < 0, "Down").otherwise("up"),
        )
        .when(ord_ % 7 == 0, F.lower(last))
        .when(ord_ % 11 == 0, "cmd+c")
        .when(raw == "Return", "enter")
        .otherwise(last)
    )
    kind = (
        F.when(F.col("etype") == "KeyPress", "KeyPress")
        .when(F.col("etype") == "MousePress", "MouseClick")
        .otherwise("MouseScroll")
    )
    return log.select(
        "recording_id",
        ord_.alias("pos"),
        F.when(frame < 0, "F-1").otherwise(frame_label(frame)).alias("frame"),
        kind.alias("type"),
        details.alias("details"),
    )


def scored_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_predictions(preds(spark, sf_dir))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers: the predictions of 16 log rows as a JSON list, wrapped in four ways."""
    item = F.struct("frame", "type", "details")
    listed = (
        preds(spark, sf_dir)
        .groupBy(F.floor(F.col("pos") / 16).alias("response_id"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.to_json(item).alias("j")))).alias("items"))
    )
    text = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["j"]), ","), F.lit("]"))
    kind = F.col("response_id") % 4
    wrapped = (
        F.when(kind == 0, text)
        .when(kind == 1, F.concat(F.lit("<think>x[1]</think>```json\n"), text, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Answer: "), text, F.lit(" done")))
        .otherwise(F.concat(F.lit("<think>never closed "), text))
    )
    return listed.select("response_id", wrapped.alias("raw_response"))


def clip_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled actions of 25-frame clips: the predictions cut up, without those whose label has no number."""
    frame = F.regexp_extract("frame", "F([0-9]+)", 1).try_cast("int")
    placed = preds(spark, sf_dir).withColumn("f", frame).where("f is not null")
    return placed.select(
        "recording_id",
        F.floor(F.col("f") / CLIP_FRAMES).cast("int").alias("chunk"),
        "pos",
        frame_label(F.col("f") % CLIP_FRAMES).alias("frame"),
        "type",
        "details",
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that have actions, with a length that varies from clip to clip."""
    found = clip_actions(spark, sf_dir).select("recording_id", "chunk").distinct()
    length = 1 + (F.col("recording_id") * 7 + F.col("chunk") * 3) % 40
    return found.withColumn("num_frames", length.cast("int"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias("recording_id")).distinct()


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two-channel pixels: 50 vectors make a recording, each value one channel."""
    channel = lambda v: F.lpad(
        F.hex(F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * 150)).cast("int")), 2, "0"
    )
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 50).alias("recording_id"),
        (F.col("vec_id") % 50).cast("int").alias("frame_idx"),
        F.unhex(F.array_join(F.transform("embedding", channel), "")).alias("data"),
        F.lit(2).alias("n_channels"),
    )


def frame_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions on the frames of ``images``: 20 log rows in a row are on one frame."""
    return keylog(spark, sf_dir).select(
        F.floor(F.col("ord") / 1000).alias("recording_id"),
        (F.floor(F.col("ord") / 20) % 50).cast("int").alias("frame_idx"),
        F.lit("KeyPress").alias("type"),
        F.col("raw_key").alias("details"),
    )


# The two tokens that start an answer, and those of the roles.
MARKER = [1000, 1003]
ROLES = {"user": 1001, "system": 1002, "assistant": 1003}


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token sequence per turn: role, first half of the words, answer marker, second half.

    A word is its length. Turns of the system have no answer.
    """
    words = F.split("text", " ", -1)
    lengths = F.transform(words, lambda w: F.length(w).cast("int"))
    half = F.floor(F.size(words) / 2).cast("int")
    role = F.col("role")
    code = F.when(role == "user", ROLES["user"]).when(role == "system", ROLES["system"]).otherwise(ROLES["assistant"])
    start = F.array(F.lit(1000), code)
    marker = F.when(role == "system", F.array().cast("array<int>")).otherwise(F.array(*[F.lit(t) for t in MARKER]))
    ids = F.concat(start, F.slice(lengths, 1, half), marker, F.slice(lengths, half + 1, F.size(words)))
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("example_id"), ids.alias("ids")
    )


def write_frames(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Each vector as a grey PNG of 8 x 8 in its recording's folder, written by the tasks; every 97th
    file is broken. The table is small beside the work on its rows, so these are dealt to all cores."""
    rows = images(spark, sf_dir).select("recording_id", "frame_idx", "data")
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, "recording_id")

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written, made = 0, ""
        for batch in batches:
            for recording, frame, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines = b"".join(b"\0" + data[at : at + 8] for at in range(0, len(data), 8))
                head = struct.pack(">IIBBBBB", 8, len(data) // 8, 8, 0, 0, 0, 0)
                png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
                folder = f"{root}/recording_id={recording}"
                if folder != made:
                    make_folder(made := folder)
                with open_path(f"{folder}/F{frame:02d}.png", "wb") as file:
                    file.write(png if (recording * 50 + frame) % 97 else png[:30])
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["written"])

    rows.mapInArrow(run, "written bigint").agg(F.sum("written")).collect()

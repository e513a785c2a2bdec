"""Input logs: entries ``[ts_us, [type, payload]]`` as JSON or binary files."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import BUTTONS, payload_button, payload_key
from ..functions.text import json_list
from .files import list_files
from .paths import open_path
from .schemas import PARSED_LOG


def _typed(entry: Column) -> Column:
    """The parsed entry as a struct, inside an array that binds each step once."""

    def at(v: Column, path: str, data_type: str = "string") -> Column:
        return F.try_variant_get(v, path, data_type)

    def head(v: Column) -> Column:
        time, etype = at(v, "$[0]", "bigint"), at(v, "$[1][0]")
        return F.struct(v.alias("v"), time.alias("ts_us"), etype.alias("etype"))

    def typed(e: Column) -> Column:
        v, etype = e["v"], e["etype"]
        payload = F.array(at(v, "$[1][1][0]"), at(v, "$[1][1][1]"))
        scrolls = etype == "MouseScroll"
        dx, dy = at(v, "$[1][1][0]", "double"), at(v, "$[1][1][1]", "double")
        words = F.when(etype == "ContextChanged", at(v, "$[1][1]", "array<string>"))
        return F.struct(
            e["ts_us"].alias("ts_us"),
            etype.alias("etype"),
            F.when(etype.isin("KeyPress", "KeyRelease"), payload_key(payload)).alias("raw_key"),
            F.when(etype.isin("MousePress", "MouseRelease"), payload_button(payload)).alias("button"),
            F.when(scrolls, dx).otherwise(F.lit(0.0)).alias("dx"),
            F.when(scrolls, dy).otherwise(F.lit(0.0)).alias("dy"),
            F.when(scrolls, at(v, "$[1][1].direction")).alias("direction"),
            F.coalesce(F.array_contains(words, "UNCAPTURED"), F.lit(False)).alias("uncaptured"),
        )

    return F.transform(F.transform(F.array(F.try_parse_json(entry)), head), typed)


def _valid(typed: Column) -> Column:
    return typed["ts_us"].isNotNull() & typed["etype"].isNotNull()


def parse_entries(entries: DataFrame) -> DataFrame:
    """Typed columns from one JSON entry per row (column ``entry``); invalid entries vanish.

    Valid are lists of two or more whose first element is a time (fractions are cut off) and
    whose second is a list that is not empty.
    """
    kept = [c for c in entries.columns if c != "entry"]
    return entries.select(*kept, F.inline(F.filter(_typed(F.col("entry")), _valid)))


def corrupt_entries(entries: DataFrame) -> DataFrame:
    """The entries that ``parse_entries`` drops, as they are, with the ``reason``."""
    read = F.try_parse_json("entry")
    listed = F.coalesce(F.schema_of_variant(read).startswith("ARRAY"), F.lit(False))
    typed = F.element_at(_typed(F.col("entry")), 1)
    reason = (
        F.when(read.isNull(), "not JSON")
        .when(~listed, "not a list")
        .when(F.try_variant_get(read, "$[1]", "variant").isNull(), "no event")
        .when(typed["ts_us"].isNull(), "no time")
        .otherwise("no event type")
    )
    return entries.where(~F.exists(_typed(F.col("entry")), _valid)).withColumn("reason", reason)


def entries_of(logs: DataFrame, column: str = "entries") -> DataFrame:
    """One row per entry of logs held as a JSON list, ``ord`` being the place in the list."""
    items = json_list(F.col(column))
    return logs.select("*", F.posexplode(items).alias("ord", "entry")).drop(column)


def read_json_keylogs(spark: SparkSession, path: str) -> DataFrame:
    """Logs of one JSON list per file; ``recording_id`` is the file path."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("recording_id"), F.col("value").alias("entries")
    )
    return parse_entries(entries_of(files))


# MessagePack type bytes of numbers (struct format) and of sized values (the
# format of the size and the kind).
_NUMBERS = {
    0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q",
    0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q",
}
_SIZED = {
    0xC4: (">B", "bin"), 0xC5: (">H", "bin"), 0xC6: (">I", "bin"),
    0xD9: (">B", "str"), 0xDA: (">H", "str"), 0xDB: (">I", "str"),
    0xDC: (">H", "list"), 0xDD: (">I", "list"), 0xDE: (">H", "map"), 0xDF: (">I", "map"),
}
_PLAIN = {0xC0: None, 0xC2: False, 0xC3: True}
# Extension values: a type byte, then as many bytes as the code or the size says.
_FIXED_EXTENSIONS = {0xD4: 1, 0xD5: 2, 0xD6: 4, 0xD7: 8, 0xD8: 16}
_EXTENSIONS = {0xC7: ">B", 0xC8: ">H", 0xC9: ">I"}


def _unpack(data: memoryview, at: int):
    code = data[at]
    at += 1
    if code <= 0x7F or code >= 0xE0:
        return (code if code <= 0x7F else code - 256), at
    if code in _PLAIN:
        return _PLAIN[code], at
    if code in _NUMBERS:
        form = _NUMBERS[code]
        return struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
    if code in _FIXED_EXTENSIONS or code in _EXTENSIONS:
        size = _FIXED_EXTENSIONS.get(code)
        if size is None:
            form = _EXTENSIONS[code]
            size, at = struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
        raw = bytes(data[at + 1 : at + 1 + size])
        if len(raw) < size:
            raise CutOff("value cut off")
        return raw.decode("latin-1"), at + 1 + size
    if code in _SIZED:
        form, kind = _SIZED[code]
        size, at = struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
    elif code < 0xC0:
        kind = "str" if code >= 0xA0 else "list" if code >= 0x90 else "map"
        size = code & (0x1F if kind == "str" else 0x0F)
    else:
        raise ValueError(f"unknown type byte {code:#x}")
    if kind in ("str", "bin"):
        raw = bytes(data[at : at + size])
        if len(raw) < size:
            raise CutOff("value cut off")
        return raw.decode("utf-8", "replace"), at + size
    items = []
    for _ in range(size * (2 if kind == "map" else 1)):
        item, at = _unpack(data, at)
        items.append(item)
    return (dict(zip(items[::2], items[1::2])) if kind == "map" else items), at


class CutOff(ValueError):
    """The bytes at hand end inside a value."""


def stream_entries(file: BinaryIO, size: int = 1 << 20) -> Iterator:
    """The elements of a MessagePack list, by the public format description, one after another.

    At most the bytes of one element, and ``size`` more, are held."""
    data, at = file.read(size), 0
    code = data[0] if data else 0
    if not 0x90 <= code <= 0x9F and code not in (0xDC, 0xDD):
        raise ValueError("not a list of entries")
    while len(data) < 5 and (more := file.read(size)):
        data += more
    if code <= 0x9F:
        count, at = code & 0x0F, 1
    else:
        form = _SIZED[code][0]
        if len(data) < 1 + struct.calcsize(form):
            raise CutOff("value cut off")
        count, at = struct.unpack_from(form, data, 1)[0], 1 + struct.calcsize(form)
    wanted = size
    for _ in range(count):
        while True:
            try:
                value, at = _unpack(memoryview(data), at)
                break
            except (CutOff, IndexError, struct.error):
                more = file.read(wanted)
                if not more:
                    raise CutOff("value cut off") from None
                data, at, wanted = data[at:] + more, 0, wanted * 2
        wanted = size
        yield value
    if at < len(data) or file.read(1):
        raise ValueError("bytes after the value")


def unpack(content: bytes):
    """Decode one MessagePack value."""
    value, end = _unpack(memoryview(content), 0)
    if end != len(content):
        raise ValueError("bytes after the value")
    return value


def read_binary_keylogs(
    spark: SparkSession, path: str, decode: Callable[[BinaryIO], Iterator] = stream_entries, glob: str = "*.msgpack"
) -> DataFrame:
    """Rows of binary logs, opened inside the tasks; those of unreadable files and entries are left out.

    ``decode`` gives the entries of an open file one after another, so a log of any length is read
    in bounded memory. A file is checked to its end before its rows are passed on."""
    tagged = tag_keylogs(list_files(spark, path, glob), decode, check=True)
    return tagged.where("reason is null").drop("reason")


def quarantine_keylogs(
    spark: SparkSession, path: str, target: str, decode: Callable[[BinaryIO], Iterator] = stream_entries, glob: str = "*.msgpack"
) -> tuple[DataFrame, DataFrame]:
    """Rows of the readable logs, and what is bad: ``recording_id, ord, reason``, where ``ord`` is null
    for a file. Each log is opened and decoded once; ``target`` keeps both."""
    good, bad = kept_apart(tag_keylogs(list_files(spark, path, glob), decode), target)
    files = bad.where("ord is null").select("recording_id").distinct()
    return good.join(files, "recording_id", "left_anti"), bad.select("recording_id", "ord", "reason")


def kept_apart(tagged: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Good and bad rows of a table whose ``reason`` tells them apart, written once in one pass."""
    tagged.withColumn("bad", F.col("reason").isNotNull()).write.partitionBy("bad").parquet(target)
    read = tagged.sparkSession.read.schema(f"{_ddl(tagged)}, bad boolean").parquet(target)
    return read.where("not bad").drop("bad", "reason"), read.where("bad").drop("bad")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


BATCH = 10_000  # rows that a decoding task holds


def tag_keylogs(
    paths: DataFrame, decode: Callable[[BinaryIO], Iterator] = stream_entries, check: bool = False
) -> DataFrame:
    """Entries of the logs in a table of paths: ``schemas.PARSED_LOG`` and the ``reason`` why an entry,
    or where ``ord`` is null a whole file, is bad. The recording is named by its ``recording_id`` in the
    table, or else by its path.

    Entries become typed columns where they are decoded. With ``check`` a bad file has no rows but its
    reason, for which it is decoded twice; else rows before the fault are there too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for path, name in named:
            held: list[tuple] = []
            try:
                if check:
                    with open_path(path) as file:
                        for _ in decode(file):
                            pass
                with open_path(path) as file:
                    for ord_, entry in enumerate(decode(file)):
                        held.append((name, ord_, *typed_entry(entry)))
                        if len(held) == BATCH:
                            yield _batch(held)
                            held = []
            except (ValueError, IndexError, struct.error, OSError) as broken:
                held.append((name, None, *_NOTHING, str(broken) or type(broken).__name__))
            yield _batch(held)

    name = F.col("recording_id" if "recording_id" in paths.columns else "path")
    return paths.select("path", name.alias("recording_id")).mapInArrow(run, f"{PARSED_LOG}, reason string")


_KINDS = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.bool_(), pa.string(), pa.string()]
_NAMES = [column.split()[0] for column in f"{PARSED_LOG}, reason string".split(", ")]
_NOTHING = (None,) * (len(_NAMES) - 3)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)


def _text(value) -> str | None:
    """A single value as text."""
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (str, int, float)) else None


def _number(value, kind: type):
    """A single value as a number; null where it is none, or too large."""
    if not isinstance(value, (str, int, float)):
        return None
    try:
        found = kind(value)
    except (ValueError, OverflowError):
        return None
    return None if kind is int and not -(2**63) <= found < 2**63 else found


def typed_entry(entry) -> tuple:
    """The typed columns of a decoded entry, and the reason why it is bad; as ``parse_entries`` and
    ``corrupt_entries`` have them for JSON."""
    if not isinstance(entry, list):
        return *_NOTHING, "not a list"
    if len(entry) < 2:
        return *_NOTHING, "no event"
    ts_us, event = _number(entry[0], int), entry[1] if isinstance(entry[1], list) else []
    etype = _text(event[0]) if event else None
    if ts_us is None or etype is None:
        return *_NOTHING, "no time" if ts_us is None else "no event type"
    payload = event[1] if len(event) > 1 else None
    first, second = ([*payload, None, None] if isinstance(payload, list) else [None, None])[:2]
    key = button = direction = None
    dx = dy = 0.0
    uncaptured = False
    if etype in ("KeyPress", "KeyRelease"):
        key = _text(second) if _text(second) != "UNKNOWN" else None
    elif etype in ("MousePress", "MouseRelease"):
        button = _text(first) if _text(first) in BUTTONS else None
    elif etype == "MouseScroll":
        dx, dy = _number(first, float), _number(second, float)
        direction = _text(payload.get("direction")) if isinstance(payload, dict) else None
    elif etype == "ContextChanged":
        uncaptured = isinstance(payload, list) and "UNCAPTURED" in payload
    return ts_us, etype, key, button, dx, dy, uncaptured, direction, None

"""Substring deduplication by seed and extend.

Every window of `length` words picks the smallest hash among its k-word grams as its anchor, so
equal windows pick equal anchors at equal places. An anchor and all windows that picked it make a
seed: the anchor extended both ways as far as they reach. Seeds whose anchor occurs once are
dropped. Equal seeds form a class, and all but its first occurrence are repeats in full. Where an
anchor has several classes, as at the ends of a repeat, their first occurrences are extended
window by window. Repeats are then joined to maximal ones.

Classes and windows are led by their first occurrence, so nothing pairs the members of a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inputtrace.llm.common import carried, numbered, stored, table

LENGTH = 20
GRAM = 8
BITS = 26  # of the table that says which anchors may occur twice; fixed, whatever the input

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BYTE = np.uint64(0x9E3779B97F4A7C15)
_WORD = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of an odd number modulo 2 ** 64, and of its inverse, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            top, low = self.up[-1:] * self.base, self.down[-1:] * self.inverse
            self.up = np.concatenate((self.up, self.up * top))
            self.down = np.concatenate((self.down, self.down * low))


_POWERS = Powers(int(_BYTE)), Powers(_WORD[0]), Powers(_WORD[1])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in the bytes of a text."""
    inside = np.concatenate(([False], ~_BLANK[data], [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


class Line:
    """The words of a text, with hashes of any stretch of them."""

    def __init__(self, text: str):
        self.raw = text.encode("utf-8", "surrogatepass")
        data = np.frombuffer(self.raw, np.uint8)
        self.starts, self.ends = word_bounds(data)
        self.sums: list[np.ndarray] = []

    def __len__(self) -> int:
        return len(self.starts)

    def hash_words(self) -> None:
        if self.sums or not len(self):
            return
        data = np.frombuffer(self.raw, np.uint8)
        long = int((self.ends - self.starts).max())
        _POWERS[0].reach(long)
        sizes = self.ends - self.starts
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters = data[~_BLANK[data]].astype(np.uint64) + np.uint64(1)
        words = mixed(np.add.reduceat(letters * _POWERS[0].up[place], np.cumsum(sizes) - sizes))
        for powers, value in ((_POWERS[1], words), (_POWERS[2], mixed(words + _BYTE))):
            powers.reach(len(words) + 1)
            total = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(value * powers.up[: len(words)], out=total[1:])
            self.sums.append(total)

    def stretch(self, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
        """Hash of the words from `start` up to `end`."""
        total = self.sums[second]
        return mixed((total[end] - total[start]) * _POWERS[1 + second].down[start])


def seeds(line: Line, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor and extent hash of each seed."""
    if len(line) < length:
        empty = np.empty(0, np.uint64)
        return empty.astype(np.int64), empty.astype(np.int64), empty, empty
    line.hash_words()
    at = np.arange(len(line) - gram + 1)
    grams = line.stretch(at, at + gram)
    reach = length - gram + 1
    windows = len(line) - length + 1
    low = grams[:windows].copy()
    spot = np.arange(windows)
    for offset in range(1, reach):
        there = grams[offset : offset + windows]
        better = there <= low  # the last one among equals
        low[better] = there[better]
        spot[better] = np.flatnonzero(better) + offset
    first = np.flatnonzero(np.concatenate(([True], spot[1:] != spot[:-1])))
    count = np.diff(np.append(first, windows))
    extent = line.stretch(first, first + count + length - 1, True)
    place = (spot[first] - first).astype(np.uint64)
    return first, count, low[first], mixed(extent + place * _MIX[0] + count.astype(np.uint64) * _MIX[1])


def anchor_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The anchor of every seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [seeds(Line(t.as_py()), length, gram)[2] for t in batch.column(0)]
            anchors = np.concatenate(found) if found else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64))], ["anchor"])

    return rows.select("text").mapInArrow(run, "anchor bigint")


def bit_table(anchors: DataFrame) -> np.ndarray:
    """One bit per value of the anchors' highest bits: 2 ** (BITS - 6) integers at most."""
    top = F.shiftrightunsigned("anchor", 64 - BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(anchor, {64 - BITS}) & 63 as int))")
    found = anchors.select(F.shiftright(top, 6).cast("int").alias("at"), bit.alias("bit"))
    found = found.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << BITS - 6, np.int64)
    bits[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def seed_rows(rows: DataFrame, bits: np.ndarray, length: int, gram: int) -> DataFrame:
    """(row, doc, at, n, anchor, extent) of the seeds whose anchor may occur twice."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            parts, sizes = [], []
            for text in batch.column(1):
                found = seeds(Line(text.as_py()), length, gram)
                place = found[2] >> np.uint64(64 - BITS)
                maybe = known[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)
                parts.append([c[maybe == 1] for c in found])
                sizes.append(len(parts[-1][0]))
            own = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 4
            arrays = [batch.column(0).take(own), batch.column(2).take(own)]
            arrays += [pa.array(c.astype(np.int32)) for c in columns[:2]]
            arrays += [pa.array(c.view(np.int64)) for c in columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc", "at", "n", "anchor", "extent"])

    doc = rows.schema["doc"].dataType.simpleString()
    return rows.select("row", "text", "doc").mapInArrow(
        run, f"row bigint, doc {doc}, at int, n int, anchor bigint, extent bigint"
    )


def window_rows(asked: DataFrame, length: int) -> DataFrame:
    """(row, doc, at, h, g) of the windows asked for in (row, doc, text, wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, sizes = [], []
            for text, wanted in zip(batch.column(2), batch.column(3).to_pylist()):
                line = Line(text.as_py())
                line.hash_words()
                at = np.concatenate([np.arange(w["at"], w["at"] + w["n"]) for w in wanted])
                parts.append((at, line.stretch(at, at + length), line.stretch(at, at + length, True)))
                sizes.append(len(at))
            own = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 3
            arrays = [batch.column(0).take(own), batch.column(1).take(own), pa.array(columns[0].astype(np.int32))]
            arrays += [pa.array(c.view(np.int64)) for c in columns[1:]]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc", "at", "h", "g"])

    doc = asked.schema["doc"].dataType.simpleString()
    return asked.select("row", "doc", "text", "wanted").mapInArrow(
        run, f"row bigint, doc {doc}, at int, h bigint, g bigint"
    )


def later(rows: DataFrame, keys: Sequence[str], doc_id: str, name: str, *kept: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, stored as (keys, lead, several), and the rows that are not first.
    Rows come by document id, row and place."""
    order = F.struct(F.col("doc").getField(doc_id).alias("id"), "row", "at", *kept)
    leads = stored(rows.groupBy(*keys).agg(F.min(order).alias("lead"), (F.count("*") > 1).alias("several")), name)
    repeated = leads.where("several").select(*keys, F.col("lead.row").alias("lead_row"), F.col("lead.at").alias("lead_at"))
    met = rows.join(repeated, [*keys]).where((F.col("row") != F.col("lead_row")) | (F.col("at") != F.col("lead_at")))
    return leads, met


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Columns n_words, n_removed, repeats (array of word ranges, maximal and in order), kept_text
    and those of `carry`, one row per input row.

    A word is removed when a window of `length` words over it also starts earlier: in a document
    with a smaller id, or earlier in the same one. Windows are judged on the input. The kept words
    are joined by single blanks. Null text has no words; texts shorter than a window stay whole.
    Null ids are smallest; rows with one id come in the order of the input, so of repeated rows
    the first one stays. No rows give no rows. Windows are equal when two 64-bit hashes are."""
    rows = numbered(docs, text, [doc_id])
    anchors = anchor_rows(rows, length, gram).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    anchors = stored(anchors.select("anchor"), "anchors")
    found = seed_rows(rows, bit_table(anchors), length, gram)
    found = stored(found.join(anchors, "anchor", "left_semi").select(*found.columns), "seeds")
    classes, whole = later(found, ["anchor", "extent"], doc_id, "classes", "n")
    ranges = whole.select("row", "at", (F.col("at") + F.col("n") + (length - 1)).alias("end"))

    mixed_anchors = classes.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1").select("anchor")
    edges = classes.join(stored(mixed_anchors, "mixed-anchors"), "anchor", "left_semi")
    wanted = edges.select("lead.row", F.struct("lead.at", "lead.n").alias("want"))
    wanted = stored(wanted.groupBy("row").agg(F.collect_list("want").alias("wanted")), "wanted")
    windows = stored(window_rows(rows.join(wanted, "row"), length), "windows")
    _, single = later(windows, ["h", "g"], doc_id, "first-windows")
    ranges = ranges.unionByName(single.select("row", "at", (F.col("at") + length).alias("end")))

    repeats = ranges.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("at", "end"))).alias("ranges"))
    both = numbered(docs, text, carry).join(stored(repeats, "repeats"), "row", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for value, own in zip(batch.column(0), batch.column(2).to_pylist()):
                for column, cell in zip(columns, without(value.as_py(), [(r["at"], r["end"]) for r in own or ()])):
                    column.append(cell)
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            kinds = [pa.int64(), pa.int64(), span, pa.string()]
            arrays = [batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "n_words", "n_removed", "repeats", "kept_text"])

    both = both.select("text", "doc", "ranges")
    schema = (
        f"doc {both.schema['doc'].dataType.simpleString()}, n_words bigint, n_removed bigint, "
        "repeats array<struct<start:int,end:int>>, kept_text string"
    )
    return both.mapInArrow(cut, schema).select(*carried(carry), "n_words", "n_removed", "repeats", "kept_text")


def without(text: str, ranges: list[tuple[int, int]]) -> tuple[int, int, list[dict], str]:
    """Words, removed words, maximal ranges, and the text of what stays; the ranges are sorted."""
    line = Line(text)
    whole: list[list[int]] = []
    for start, end in ranges:
        if whole and start <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], end)
        else:
            whole.append([start, end])
    stay = np.ones(len(line), bool)
    for start, end in whole:
        stay[start:end] = False
    raw, kept = line.raw, zip(line.starts[stay].tolist(), line.ends[stay].tolist())
    told = b" ".join([raw[a:b] for a, b in kept]).decode("utf-8", "surrogatepass")
    return len(line), int((~stay).sum()), [{"start": a, "end": b} for a, b in whole], told


def op3_seed_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = """
with tokens as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents),
starts as (
  select doc_id, unnest(range(1, greatest(len(w) - 18, 1))) as i, w from tokens),
windows as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as s from starts),
later as (
  select doc_id, i from (
    select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from windows) where k > 1),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 20)) as p from later)),
words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from tokens),
kept as (
  select words.doc_id, count(*) as n_words, count(gone.p) as n_removed,
    string_agg(x, ' ' order by words.p) filter (where gone.p is null) as t
  from words left join gone on words.doc_id = gone.doc_id and words.p = gone.p group by words.doc_id)
select tokens.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed,
  sha256(coalesce(t, '')) as kept_sha256
from tokens left join kept on tokens.doc_id = kept.doc_id
"""

"""Benchmark decontamination by templates.

Words become a template: numbers, names and units are typed placeholders, all else is lower case
without punctuation at its ends. Windows of the template are hashed. Document windows that the
benchmark may have, by a bit table of fixed size, meet the benchmark's windows in a hash join.
Along one alignment of a document with an item, a placeholder's value in the item must always be
the same value in the document, so questions with other numbers or names are caught, and texts
that merely have a number where the item has one are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inputtrace.llm.common import carried, mapped, numbered, stored, table

WINDOW = 5  # words
SHARE = 0.5  # of an item's words that aligned windows must cover
BITS = 24  # the bit table has 2 ** BITS bits, whatever the benchmark's size
MEMO = 60_000

TOKEN = re.compile("[^\x20\x09-\x0d]+|\n")
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’‚…¡¿–—·•"
NUMBER = re.compile(r"[+-]?[$€£¥]?(\d[\d.,:/]*)(%|[^\W\d_]{1,4})?")
SENTENCE_END = re.compile(r"[.!?:;…][\"'»”’)\]]*$")
UNITS = frozenset(
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons lb lbs oz ounce ounces "
    "pound pounds ml cl l liter liters litre litres gallon gallons pint pints cup cups s sec second seconds min minute "
    "minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent "
    "degree degrees mph kmh hz khz mhz ghz w kw v a j kj cal kcal kb mb gb tb gram grams kilogram kilograms meter "
    "meters metre metres kilometer kilometers centimeter centimeters".split()
)  # fixed list
WORD, NUMERIC, UNIT, CAPITAL, BREAK, NOTHING = range(6)
NUMBER_SLOT, UNIT_SLOT, NAME_SLOT = (xxhash.xxh64_intdigest(p, 7) for p in ("<number>", "<unit>", "<name>"))
BASE = 0x9E3779B97F4A7C15


def read_token(token: str) -> tuple[int, int, bool, str]:
    """Kind, hash, whether a sentence ends here, and the bare word."""
    if token == "\n":
        return BREAK, 0, True, ""
    bare = token.strip(EDGES)
    ends = bool(SENTENCE_END.search(token))
    if not bare:
        return NOTHING, 0, ends, ""
    low = bare.lower()
    if NUMBER.fullmatch(bare):
        return NUMERIC, NUMBER_SLOT, ends, low
    kind = WORD
    if low in UNITS:
        kind = UNIT
    elif bare[0].isupper() and not bare.isupper():
        kind = CAPITAL
    return kind, xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 7), ends, low


class Tokens:
    """What is known of tokens, as columns over their numbers."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.bare: list[str] = []
        self.kind, self.hash, self.ends = np.empty(1024, np.int8), np.empty(1024, np.uint64), np.empty(1024, bool)

    def add(self, token: str) -> None:
        kind, value, ends, bare = read_token(token)
        at = len(self.bare)
        if at == len(self.kind):
            self.kind, self.hash, self.ends = (np.concatenate((c, c)) for c in (self.kind, self.hash, self.ends))
        self.kind[at], self.hash[at], self.ends[at] = kind, value, ends
        self.bare.append(bare)
        self.number[token] = at


class Template:
    """Template hashes of a text's words, and the words themselves."""

    tokens = Tokens()

    def __init__(self, text: str):
        if len(Template.tokens.bare) > MEMO:
            Template.tokens = Tokens()
        known, tokens = Template.tokens, TOKEN.findall(text)
        for token in set(tokens):
            if token not in known.number:
                known.add(token)
        numbers = np.fromiter(map(known.number.__getitem__, tokens), np.int64, len(tokens))
        kind = known.kind[numbers]
        # a word starts a sentence if anything since the last word ended one
        at = np.flatnonzero(kind < BREAK)
        marks = np.concatenate(([0], np.cumsum(known.ends[numbers])))
        since = marks[at] - np.concatenate(([-1], marks[at[:-1]])) if len(at) else np.empty(0, int)
        kind, hashes = kind[at], known.hash[numbers[at]]
        after_number = np.concatenate(([False], kind[:-1] == NUMERIC)) if len(at) else np.empty(0, bool)
        name, unit = (kind == CAPITAL) & (since == 0), (kind == UNIT) & after_number
        hashes[name], hashes[unit] = NAME_SLOT, UNIT_SLOT
        self.hashes, self.slot = hashes, name | unit | (kind == NUMERIC)
        self._bare, self._numbers = known.bare, numbers[at]

    def __len__(self) -> int:
        return len(self.hashes)

    def windows(self, n: int) -> np.ndarray:
        """Hash of the n words from each place on."""
        if len(self) < n:
            return np.empty(0, np.uint64)
        total = np.full(len(self) - n + 1, n, np.uint64)
        for i in range(n):
            total = (total * np.uint64(BASE)) ^ (self.hashes[i : i + len(total)] * np.uint64(0xC2B2AE3D27D4EB4F))
            total ^= total >> np.uint64(29)
        return total * np.uint64(BASE)

    def values(self, start: int, n: int) -> list[str]:
        """The words that placeholders stand for in the n words from `start` on."""
        return [self._bare[self._numbers[i]] for i in range(start, start + n) if self.slot[i]]


WINDOWS = "at int, n int, hash bigint, vals array<string>"
ARROW = [("at", pa.int32()), ("n", pa.int32()), ("hash", pa.int64()), ("vals", pa.list_(pa.string()))]


def item_windows(items: DataFrame, text: str, item_id: str, window: int) -> DataFrame:
    """(item, item_words, at, n, hash, vals): all windows; an item shorter than a window is one."""
    rows = numbered(items, text, [item_id]).select(F.col("doc").getField(item_id).alias("item"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                template = Template(value.as_py())
                n = min(window, len(template))
                hashes = template.windows(n).view(np.int64).tolist() if n else []
                found += [(item, len(template), i, n, h, template.values(i, n)) for i, h in enumerate(hashes)]
            columns = list(zip(*found)) or [()] * 6
            kinds = [batch.schema.types[0], pa.int32(), *[k for _, k in ARROW]]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["item", "item_words", *[n for n, _ in ARROW]])

    return mapped(rows, run, f"item {rows.schema['item'].dataType.simpleString()}, item_words int, {WINDOWS}")


def bit_table(windows: DataFrame) -> np.ndarray:
    """One bit per value of the hash's highest bits that occurs; 2 ** (BITS - 6) integers at most."""
    top = F.shiftrightunsigned("hash", 64 - BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITS}) & 63 as int))")
    found = windows.select(F.shiftright(top, 6).cast("int").alias("at"), bit.alias("bit"))
    found = found.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << BITS - 6, np.int64)
    bits[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def document_windows(docs: DataFrame, text: str, bits: np.ndarray, sizes: Sequence[int]) -> DataFrame:
    """(row, at, n, hash, vals): windows of the given sizes whose bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    rows = numbered(docs, text, []).select("row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = []
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                template = Template(value.as_py())
                for n in sizes:
                    hashes = template.windows(n)
                    place = hashes >> np.uint64(64 - BITS)
                    maybe = known[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)
                    for i in np.flatnonzero(maybe).tolist():
                        found.append((row, i, n, int(hashes[i : i + 1].view(np.int64)[0]), template.values(i, n)))
            columns = list(zip(*found)) or [()] * 5
            arrays = [pa.array(list(c), k) for c, k in zip(columns, [pa.int64(), *[k for _, k in ARROW]])]
            yield pa.RecordBatch.from_arrays(arrays, ["row", *[n for n, _ in ARROW]])

    return mapped(rows, run, f"row bigint, {WINDOWS}")


def leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: float = SHARE,
) -> DataFrame:
    """Documents that hold a benchmark item: (row, item, covered, item_words, same_values), one row
    per pair.

    A pair is reported when windows on alignments with consistent placeholders cover at least
    `share` of the item's words. same_values is false when a placeholder's value differs, as in a
    question with other numbers. Null and empty texts hold no windows and null or empty items are
    in none; items shorter than a window are found as a whole. Repeated documents are reported
    each, repeated items once per id. Without items or documents there are no rows.

    An item's windows in very many documents are hot join keys, which Spark splits at run time;
    what is gathered per pair is bounded by the document's own windows."""
    wanted = stored(item_windows(items, item_text, item_id, window), "item-windows").distinct()
    sizes = sorted(r["n"] for r in wanted.select("n").distinct().collect())
    maybe = document_windows(docs, text, bit_table(wanted), sizes)
    wanted = wanted.select("item", "item_words", F.col("at").alias("item_at"), "n", "hash", F.col("vals").alias("item_vals"))
    pairs = maybe.join(wanted, ["hash", "n"]).where(F.size("vals") == F.size("item_vals"))
    lines = pairs.groupBy("row", "item", "item_words", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set(F.struct("item_at", "n")).alias("hit"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_vals", "vals")))).alias("slots"),
    )
    item_values = F.array_distinct(F.transform("slots", lambda s: s["item_vals"]))
    same = F.forall("slots", lambda s: s["item_vals"] == s["vals"])
    lines = lines.where(F.size("slots") == F.size(item_values)).withColumn("same", same)
    places = F.flatten(F.transform("hit", lambda h: F.sequence(h["item_at"], h["item_at"] + h["n"] - 1)))
    found = lines.select("row", "item", "item_words", "same", F.array_distinct(places).alias("places"))
    found = found.groupBy("row", "item", "item_words").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("covered"), F.bool_and("same").alias("same_values")
    )
    return found.where(F.col("covered") >= F.lit(share) * F.col("item_words"))


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the items they hold."""
    docs = table(spark, sf_dir, "documents")
    found = stored(leaks(docs, table(spark, sf_dir, "benchmark")), "leaks")
    rows = numbered(docs, "doc_id", ["doc_id"]).drop("text")
    return rows.join(found, "row").select(
        *carried(["doc_id"]), F.col("item").alias("item_id"), F.col("covered").cast("long").alias("covered_words"),
        F.col("item_words").cast("long").alias("item_words"), "same_values",
    )

"""Language identification by rank order: a document's most frequent n-grams against each
language's, by out-of-place distance.

Learning counts n-grams of one to three letters per language over all training documents: each
task hands on counts, never texts. Only the profiles, `size` n-grams per language, reach the
driver and the scoring tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inputtrace.llm.common import carried, mapped, numbered, slices, table

SIZE = 400  # n-grams of a profile, and of a document that count
UNKNOWN = "und"
SALTS = 16
HELD = 1 << 20  # distinct n-grams a task holds before it hands counts on
PART = 256  # texts whose counts are held apart before they are added up


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the lower-cased text's words, each word between blanks, and their counts.

    An n-gram is three 21-bit code points in one integer, the first one lowest; a blank has the
    code of a space, and no n-gram spans two words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes[~letter] = 32
    inside = letter.copy()
    inside[1:] |= letter[:-1]
    line = np.concatenate(([32], codes[inside], [32]))
    blank = line == 32
    two = line[:-1] | line[1:] << 21
    three = line[:-2] | line[1:-1] << 21 | line[2:] << 42
    parts = (line[~blank], two[~(blank[:-1] & blank[1:])], three[~blank[1:-1]])
    return np.unique(np.concatenate(parts), return_counts=True)


def ranked(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    return values[np.lexsort((values, -counts))[:size]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def merged(parts):
        values, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, place, np.concatenate([p[1] for p in parts]))
        return values, counts

    def out():
        for lang, (values, counts) in held.items():
            names = pa.array([lang] * len(values), pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(values), pa.array(counts)], ["lang", "gram", "n"])

    for batch in slices(batches, PART):
        found: dict[str, list] = {}
        for text, lang in zip(batch.column(0), batch.column(1)):
            found.setdefault(lang.as_py(), []).append(grams(text.as_py()))
        for lang, parts in found.items():
            held[lang] = merged(parts + ([held[lang]] if lang in held else []))
        if sum(len(v) for v, _ in held.values()) > HELD:
            yield from out()
            held = {}
    yield from out()


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> dict[str, list[int]]:
    """The profile of each language: its most frequent n-grams in order. Rows without a language
    or a text are left out; no rows give no profiles.

    A language's n-grams are ranked in 16 parts first, so the driver reads at most 16 x size rows
    per language."""
    known = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).dropna()
    counts = mapped(known, _count, "lang string, gram bigint, n bigint")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(SALTS))).orderBy(F.desc("n"), "gram")
    best = counts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= size).drop("k").toPandas()
    return {
        name: ranked(rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), size).tolist()
        for name, rows in best.groupby("lang")
    }


class Profiles:
    """Profiles laid out for lookup: the rank of each n-gram in each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.names, self.size = sorted(profiles), size
        self.known = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.rank = np.full((len(self.known) + 1, len(self.names)), -1, np.int64)
        for column, name in enumerate(self.names):
            own = np.array(profiles[name], np.int64)
            self.rank[np.searchsorted(self.known, own), column] = np.arange(len(own))

    def predict(self, text: str) -> tuple[str, float]:
        values, counts = grams(text)
        if not len(values) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(values, counts, self.size)
        place = np.searchsorted(self.known, own)
        place[(place == len(self.known)) | (self.known[np.minimum(place, len(self.known) - 1)] != own)] = len(self.known)
        rank = self.rank[place]
        apart = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None]))
        total = apart.sum(0)
        best = int(total.argmin())
        return self.names[best], 1.0 - float(total[best]) / (len(own) * self.size)


def predict(
    docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = SIZE, carry: Sequence[str] = ()
) -> DataFrame:
    """Columns lang_pred, score and those of `carry`, one row per input row.

    The nearest profile wins, ties by name; the score is one less the mean distance as a share of
    the profile size: 1 for the same ranks, 0 if no n-gram is known. Null text, text without a
    letter, or no profiles at all: `und` and 0. Whole texts are counted; repeated rows are alike."""
    shaped = Profiles(profiles, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shaped.predict(t.as_py()) for t in batch.column(0)]
            names, scores = [f[0] for f in found], [f[1] for f in found]
            arrays = [batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "lang_pred", "score"])

    rows = numbered(docs, text, carry).select("text", "doc")
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, lang_pred string, score double"
    return mapped(rows, run, schema).select(*carried(carry), "lang_pred", "score")


def fold(doc_id: Column, parts: int) -> Column:
    """Part of a row by the CRC-32 of its id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def op8_rank_order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    profiles = learn(docs.where(~held_out))
    found = predict(docs, profiles, carry=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

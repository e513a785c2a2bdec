"""Quality by compression: texts are compressed with a dictionary built from good texts and with
one built from bad texts; the size difference, as a share of the sizes, is calibrated to a score.

The model is fitted on a bounded sample of labelled rows (`sample` per class, at most `max_chars`
long each), in one task; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inputtrace.llm.common import carried, mapped, numbered, table
from inputtrace.llm.language_id import fold

SAMPLE = 3000  # labelled rows drawn per class: half for the dictionaries, half for calibration
MAX_CHARS = 20_000  # longer texts are not drawn
DICTIONARY = 1 << 16  # bytes
LEVEL = 3


class Sizes:
    """The feature of a text under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        kinds = []
        for data in (good, bad):
            words = zstandard.ZstdCompressionDict(data)
            words.precompute_compress(level=LEVEL)
            kinds.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False
                )
            )
        self.good, self.bad = kinds

    def features(self, text: str) -> tuple[float, float]:
        """Size difference, and size under the good dictionary, both as shares."""
        data = text.encode("utf-8", "surrogatepass")
        good, bad = len(self.good.compress(data)), len(self.bad.compress(data))
        return (bad - good) / (bad + good), good / (len(data) + 16)


def spread(features: np.ndarray) -> np.ndarray:
    """Terms of the calibration: the difference, and how well the text compresses at all, since
    texts that repeat themselves compress well under either dictionary."""
    return np.stack([np.ones(len(features)), features[:, 0] * 10, np.log(features[:, 1])], axis=1)


def calibrate(features: np.ndarray, labels: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge."""
    x, y = spread(features), labels
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - ridge * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary; where the samples are too few to train one, the texts themselves."""
    samples = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(samples)[-size:] or b"\n" * 8


def fit(rows: list[tuple[int, str]]) -> tuple[bytes, bytes, list[float]] | None:
    """Dictionaries and weights from (label, text) rows in a fixed order; None without both classes."""
    kinds = [[t for q, t in rows if q == k] for k in (1, 0)]
    if not all(kinds):
        return None
    good, bad = (dictionary(k[::2], DICTIONARY) for k in kinds)
    sizes = Sizes(good, bad)
    tests = [k[1::2] or k for k in kinds]
    features = np.array([sizes.features(t) for k in tests for t in k])
    labels = np.concatenate([np.ones(len(tests[0])), np.zeros(len(tests[1]))])
    return good, bad, calibrate(features, labels).tolist()


def learn(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    sample: int = SAMPLE, max_chars: int = MAX_CHARS,
) -> tuple[bytes, bytes, list[float]] | None:
    """The model, from labelled documents; None if a class has no rows (all scores are 0.5 then).

    Null labels and ids are left out. Rows are drawn in the order of their id's hash. The classes
    weigh as the labels do: the share of good rows moves the constant term."""
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("q")).dropna()
    known = known.withColumn("order", F.xxhash64("id"))
    picked = known.where("q = 1").orderBy("order", "id").limit(sample).unionByName(
        known.where("q = 0").orderBy("order", "id").limit(sample)
    )
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    drawn = texts.join(F.broadcast(picked), "id").where(F.length("text") <= max_chars)
    drawn = drawn.orderBy("order", "id").limit(2 * sample).select("q", "text")
    counts = {r["q"]: r["n"] for r in known.groupBy("q").agg(F.count("*").alias("n")).collect() if r["q"] in (0, 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        model = fit(rows)
        if model:
            drawn_good = sum(q for q, _ in rows) / len(rows)
            yield pa.RecordBatch.from_pylist(
                [{"good": model[0], "bad": model[1], "weights": model[2], "share": drawn_good}],
                schema=pa.schema(
                    [("good", pa.binary()), ("bad", pa.binary()), ("weights", pa.list_(pa.float64())), ("share", pa.float64())]
                ),
            )

    made = drawn.coalesce(1).mapInArrow(run, "good binary, bad binary, weights array<double>, share double").collect()
    if not made:
        return None
    row, share = made[0], counts[1] / (counts[0] + counts[1])
    weights = list(row["weights"])
    weights[0] += float(np.log(share / (1 - share)) - np.log(row["share"] / (1 - row["share"])))
    return bytes(row["good"]), bytes(row["bad"]), weights


def score(
    docs: DataFrame, model: tuple[bytes, bytes, list[float]] | None, text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """Column score, 0 to 1, and those of `carry`, one row per input row. Null text is the empty
    text, which is scored as any other; without a model every score is 0.5."""
    rows = numbered(docs, text, carry).select("text", "doc")
    if model is None:
        return rows.select(*carried(carry), F.lit(0.5).alias("score"))
    good, bad, weights = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, w = Sizes(good, bad), np.array(weights)
        for batch in batches:
            features = np.array([sizes.features(t.as_py()) for t in batch.column(0)]).reshape(-1, 2)
            values = 1 / (1 + np.exp(-np.clip(spread(features) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(values)], ["doc", "score"])

    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, score double"
    return mapped(rows, run, schema).select(*carried(carry), "score")


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = learn(docs, labels.where(~held_out))
    found = score(docs, model, carry=["doc_id"])
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )

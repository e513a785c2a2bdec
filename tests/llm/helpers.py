"""Inputs and slow models for the text operators."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)]
    return stored(spark, spark.createDataFrame(rows, SCHEMA))


def stored(spark, df):
    """Row numbers follow from a stored table."""
    from inputtrace.llm.common import stored as store

    return store(df, "test-input")


def clashing(docs):
    """Columns named like the operators' own ones."""
    from pyspark.sql import functions as F

    names = ["row", "doc", "digest", "kept", "lines", "fp", "score", "n", "ids", "anchor", "key", "gone"]
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def sentences(n, seed=0, words=40, vocabulary=300):
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(known) for _ in range(words)) for _ in range(n)]

"""The corpus pipeline: documents to deduplicated, clean token sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it wrote, and works on
all of it. All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inputtrace.llm.bpe import build_lexicon, default_path, encode
from inputtrace.llm.common import carried, numbered, stored, table
from inputtrace.llm.decontaminate import leaks
from inputtrace.llm.exact_dedup import deduplicate, new_index
from inputtrace.llm.language_id import UNKNOWN, fold, learn, predict
from inputtrace.llm.simhash import group_near

MIN_SCORE = 0.2  # of the language score: 0 is text without a known n-gram, 1 that of the profile itself


def wrapped(docs: DataFrame) -> DataFrame:
    """The columns the stages read, and all columns as one, so that no name can clash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select("doc_id", "text", "lang", whole.alias("whole"))


def unwrapped(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay. Those without a letter go, and those whose n-grams are
    unlike every language's. Learned from the documents that the held-out fold leaves."""
    profiles = learn(docs.where(fold(F.col("doc_id"), 4) != 2))
    found = predict(wrapped(docs), profiles, carry=["whole"])
    return unwrapped(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)), docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays: the one with the largest id."""
    return unwrapped(deduplicate(wrapped(docs), new_index(docs), carry=["whole"]).where("kept"), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id. Near copies
    are texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8; links by
    fingerprint are verified, and what they miss is found by shared shingles."""
    found = group_near(wrapped(docs), words=5, distance=8, blocks=8, agree=3, layouts=3, carry=["whole"], similarity=0.8)
    return unwrapped(found.where("first"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = stored(leaks(docs, table(spark, sf_dir, "benchmark")).select("row").distinct(), "leaks")
    rows = numbered(docs, "text", docs.columns).drop("text")
    return rows.join(found, "row", "left_anti").select(*carried(docs.columns))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document: doc_id, lang, source, n_tokens, ids."""
    path = default_path()
    found = encode(docs, path, build_lexicon(docs, path), carry=["doc_id", "lang", "source"])
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe),
]
ORACLE_SQL = None  # language profiles, fingerprints and merges are beyond SQL; the tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each over what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

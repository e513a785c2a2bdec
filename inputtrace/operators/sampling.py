"""Splits, samples, shards and batches, all decided by a hash of the key and a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import hash32, hash_fraction
from .ranking import ordered_rank, shuffled_rank


def split_recordings(recordings: DataFrame, key: str, train_ratio: float = 0.85, seed: int = 42) -> DataFrame:
    """Add ``split``: exactly ``int(N * train_ratio)`` recordings are train, the others val."""
    ranked = shuffled_rank(recordings, key, seed, total="_total")
    in_train = F.col("rank") <= F.floor(F.col("_total") * F.lit(float(train_ratio)))
    return ranked.withColumn("split", F.when(in_train, "train").otherwise("val")).drop("rank", "_total")


def sample_negatives(
    clips: DataFrame, key: str, n_actions: str, min_actions: int = 1, keep_ratio: float = 0.05, seed: int = 42
) -> DataFrame:
    """Keep clips with enough actions, and a fraction of the others (none at 0 or below)."""
    lucky = hash_fraction(F.col(key), seed) < F.lit(float(max(keep_ratio, 0.0)))
    return clips.where((F.col(n_actions) >= min_actions) | lucky)


def sample_validation(clips: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` clips in shuffled order."""
    return clips.orderBy(hash32(F.col(key), seed), key).limit(n)


def shard_clips(clips: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Add ``shard``: clips in order are dealt out in turn."""
    ranked = ordered_rank(clips, order)
    return ranked.withColumn("shard", ((F.col("rank") - 1) % shards).cast("int")).drop("rank")


def assign_batches(examples: DataFrame, key: str, batch_size: int, seed: int = 42) -> DataFrame:
    """Add ``batch_id``; the last batch is dropped unless it is full."""
    ranked = shuffled_rank(examples, key, seed, total="_total")
    batch = F.floor((F.col("rank") - 1) / batch_size)
    full = F.floor(F.col("_total") / batch_size)
    return ranked.withColumn("batch_id", batch).where(F.col("batch_id") < full).drop("rank", "_total")


def first_recordings(recordings: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` in order; 0 or below means all."""
    return recordings.orderBy(order).limit(n) if n > 0 else recordings

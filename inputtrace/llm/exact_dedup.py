"""Exact deduplication against a persistent digest index.

The index is a table of text digests, bucketed and sorted by digest. A batch is reduced to one
row per digest, met with the index by a sort-merge join without moving the index, and what the
anti-join leaves is appended. Texts never move for the decision: only digests do.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inputtrace.llm.common import SortedTable, bucket_count, carried, numbered, stored, table
from inputtrace.session import scratch_path


class DigestIndex:
    """Digests seen so far, with the document that stays for each."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        self.seen = SortedTable(
            spark, path, f"digest binary, keep_id {id_type}", ["digest"], buckets or bucket_count(spark)
        )

    def meet(self, groups: DataFrame) -> DataFrame:
        """The groups with `fresh`, false where the index has the digest; its keep_id holds then."""
        known = self.seen.read().select("digest", F.struct("keep_id").alias("known"))
        joined = groups.join(known.hint("merge"), "digest", "left")
        return joined.withColumn("fresh", F.col("known").isNull()).withColumn(
            "keep_id", F.when(F.col("known").isNull(), F.col("keep_id")).otherwise(F.col("known.keep_id"))
        ).drop("known")

    def append(self, fresh: DataFrame) -> None:
        self.seen.append(fresh.select("digest", "keep_id"))


def deduplicate(
    docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """Columns keep_id, group_size, kept, digest and those of `carry`, one row per input row; the
    new digests are in the index afterwards.

    Of the batch's rows with one text, the one with the largest id is kept, unless the index has
    the text already: then none is, and keep_id comes from the index. group_size counts the rows
    of the batch. Null text is the empty text. Null ids are smallest; among repeated rows with
    one id, one is kept. An empty batch gives no rows and leaves the index as it is. Digests are
    SHA-256, so equal digests count as equal texts.

    Copies are counted before they are shuffled; a digest with very many copies meets its one
    group row in a join whose large side Spark splits at run time."""
    rows = _digests(docs, doc_id, text, carry)
    groups = _meet(rows, index, doc_id)
    return _told(rows, groups, carry)


def deduplicate_batches(
    docs: DataFrame, index: DigestIndex, batches: int = 4, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """The same result, reached in batches that meet the index one after the other: ranges of ids, the
    largest first, so that the row to be kept is the first that the index sees of its text.

    A batch finds the digests of those before it in the index, takes its keep_id from there and appends
    what the index lacks. group_size counts the rows of all batches. Rows with one id share a batch and
    null ids come last, so cases are as in `deduplicate`. The ranges hold about as many rows each;
    their bounds are numbers, on which no result depends."""
    rows = stored(_digests(docs, doc_id, text, carry), "digests")
    number = F.col("doc").getField(doc_id)
    shares = [i / batches for i in range(1, batches)]
    bounds = rows.agg(F.percentile_approx(number, shares).alias("b")).first()["b"] if shares else None
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds or []]).cast("array<bigint>"), lambda b: b < number))
    part = F.when(number.isNull(), 0).otherwise(part)
    met = [_meet(rows.where(part == i), index, doc_id) for i in reversed(range(batches))]
    kept = F.struct("keep_id", "keep_row", "fresh")
    # A digest has one keep_id in all batches, and is fresh in one of them at most.
    groups = reduce(DataFrame.unionByName, met).groupBy("digest").agg(
        F.sum("group_size").alias("group_size"), F.max_by(kept, "fresh").alias("kept")
    )
    return _told(rows, groups.select("digest", "group_size", "kept.*"), carry)


def _digests(docs: DataFrame, doc_id: str, text: str, carry: Sequence[str]) -> DataFrame:
    return numbered(docs, text, [*dict.fromkeys([doc_id, *carry])]).select(
        "row", "doc", F.unhex(F.sha2("text", 256)).alias("digest")
    )


def _meet(rows: DataFrame, index: DigestIndex, doc_id: str) -> DataFrame:
    """The digests of a batch, met with the index, which has them afterwards."""
    last = F.max(F.struct(F.col("doc").getField(doc_id).alias("id"), "row"))
    groups = rows.groupBy("digest").agg(last.alias("last"), F.count("*").alias("group_size"))
    groups = groups.select(
        "digest", "group_size", F.col("last.id").alias("keep_id"), F.col("last.row").alias("keep_row")
    )
    groups = stored(index.meet(groups), "digest-groups")
    index.append(groups.where("fresh"))
    return groups


def _told(rows: DataFrame, groups: DataFrame, carry: Sequence[str]) -> DataFrame:
    return rows.join(groups, "digest").select(
        *carried(carry), "keep_id", "group_size", (F.col("fresh") & (F.col("row") == F.col("keep_row"))).alias("kept"),
        "digest",
    )


def new_index(docs: DataFrame, doc_id: str = "doc_id") -> DigestIndex:
    """An empty index in the shared folder, with ids of the documents' type."""
    path = scratch_path(docs.sparkSession, "digest-index")
    return DigestIndex(docs.sparkSession, path, docs.schema[doc_id].dataType.simpleString())


def op5_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = deduplicate_batches(docs, new_index(docs), carry=["doc_id"])
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP5_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""

"""Helpers the operators share."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inputtrace.session import scratch_path

WORD = re.compile("[^\x20\x09-\x0d]+")  # fixed by the query contracts
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hold_splits(spark: SparkSession) -> None:
    """Files are split alike in all jobs of the session. Else the split follows the cores that
    are there when a job is planned, and row numbers shift with an executor lost or come back."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def numbered(docs: DataFrame, text: str, carry: Sequence[str]) -> DataFrame:
    """Rows (row, text, doc): a number that tells rows apart even where ids are null or repeated,
    the text (null is empty), and the carried columns as one struct, so that no name can clash.

    The number follows from the place in the input, so the input must be a stored table, and from
    how its files are split, which is held for the session."""
    hold_splits(docs.sparkSession)
    kept = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        kept.alias("doc"),
    )


def carried(columns: Iterable[str]) -> list[Column]:
    """The carried columns under their own names."""
    return [F.col("doc").getField(c).alias(c) for c in columns]


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read again: cuts lineage and work. The files of
    the write's own shuffles go when it ends, so that the disk holds those of one step and not of all."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


THRESHOLD, BROADCAST = "spark.sql.autoBroadcastJoinThreshold", 256 << 10


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Of its own accord Spark broadcasts no table of more than BROADCAST bytes in joins planned meanwhile. It
    goes by the size of files, which are far smaller than the rows in the driver's memory where values repeat."""
    before = spark.conf.get(THRESHOLD, None)
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    spark.conf.set(THRESHOLD, str(min(limit, BROADCAST)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(THRESHOLD)
        else:
            spark.conf.set(THRESHOLD, before)


def discarded(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Arrow batches through `run`; a worker gives back after each task what Arrow and the C library
    hold in reserve."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return rows.mapInArrow(whole, schema)


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class SortedTable:
    """A Parquet table in the shared folder, bucketed and sorted by its keys.

    Joins and groupings on the keys read it without a shuffle. A later session opens the same
    path again; the number of buckets is then the one it was made with."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self.name = f"sorted_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        by = ", ".join(self.keys)
        spark.sql(
            f"create table if not exists {self.name} ({schema}) using parquet clustered by ({by}) "
            f"sorted by ({by}) into {buckets} buckets location '{path}'"
        )

    def append(self, rows: DataFrame) -> None:
        names = self.spark.table(self.name).columns
        dealt = rows.select(*names).repartition(self.buckets, *self.keys).sortWithinPartitions(*self.keys)
        dealt.write.insertInto(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forget the table and delete its files."""
        self.spark.sql(f"drop table if exists {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

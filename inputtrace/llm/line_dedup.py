"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

A run is a table (h1, h2, n), sorted and bucketed by the two 64-bit hashes of a line's key; n is
the number of documents that hold the line. Each batch is one new run at level 0. When a level
has `fanout` runs, they are merged into one run of the next level. Runs share their bucketing,
so a batch is anti-joined with each of them without moving any.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inputtrace.llm.common import LOWER, SPACES, UPPER, SortedTable, bucket_count, carried, numbered, stored, table
from inputtrace.session import scratch_path

KEYS = ["h1", "h2"]
RUN = "h1 bigint, h2 bigint, n bigint"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def key_of(line: Column) -> Column:
    """The line without white space at its ends, A-Z as a-z."""
    return F.btrim(F.translate(line, UPPER, LOWER), F.lit(SPACES))


def hashed(df: DataFrame, *others: str) -> DataFrame:
    return df.select(*others, F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def line_counts(docs: DataFrame, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """Documents per line key (h1, h2, n) and the columns `by`. Null text has one empty line; empty
    keys are left out."""
    keys = F.array_distinct(F.transform(lines_of(F.coalesce(F.col(f"`{text}`"), F.lit(""))), key_of))
    found = docs.select(*by, F.explode(keys).alias("key")).where("key <> ''")
    return hashed(found, *by).groupBy(*by, *KEYS).agg(F.count("*").alias("n"))


def batch_counts(docs: DataFrame, batches: int, text: str = "text") -> list[DataFrame]:
    """`line_counts` of batches, to which rows are dealt by the hash of their place in the input, so the
    input must be a stored table. All are counted in one pass and kept in the shared folder."""
    dealt = docs.select(
        F.col(f"`{text}`").alias("text"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches)).cast("int").alias("batch"),
    )
    path = scratch_path(docs.sparkSession, "line-batches")
    line_counts(dealt, by=["batch"]).write.partitionBy("batch").parquet(path)
    every = docs.sparkSession.read.schema(f"{RUN}, batch int").parquet(path)
    return [every.where(F.col("batch") == b).drop("batch") for b in range(batches)]


class LineRuns:
    """The runs below a folder. A manifest file per change says which runs hold; the highest counts."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.version, self.made, self.buckets = 0, 0, buckets or bucket_count(spark)
        self.levels: list[list[str]] = []
        fs, folder = self._fs(f"{path}/manifest")
        if fs.exists(folder):
            last = self.spark.read.json(f"{path}/manifest").orderBy(F.desc("version")).first()
            self.version, self.made, self.buckets = last["version"], last["made"], last["buckets"]
            self.levels = [list(x) for x in json.loads(last["levels"])]

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _save(self) -> None:
        self.version += 1
        row = (self.version, self.made, self.buckets, json.dumps(self.levels))
        made = self.spark.createDataFrame([row], "version int, made int, buckets int, levels string")
        made.coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def _table(self, run: str) -> SortedTable:
        return SortedTable(self.spark, f"{self.path}/{run}", RUN, KEYS, self.buckets)

    def _write(self, level: int, counts: DataFrame) -> None:
        self.made += 1
        run = f"run-{self.made}"
        self._table(run).append(counts)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(run)

    def counts(self, runs: Sequence[str] | None = None) -> DataFrame:
        """Documents per line over the given runs, or all.

        Several runs are read as plain files: Spark 4.1 takes a union of tables with one bucketing
        for bucketed itself, and would leave the same line apart in each run."""
        names = [r for level in self.levels for r in level] if runs is None else runs
        if not names:
            return self.spark.createDataFrame([], RUN)
        if len(names) == 1:
            return self._table(names[0]).read()
        whole = reduce(DataFrame.unionByName, [self.spark.read.schema(RUN).parquet(f"{self.path}/{r}") for r in names])
        return whole.groupBy(*KEYS).agg(F.sum("n").alias("n"))

    def unseen(self, counts: DataFrame, least: int = 1) -> DataFrame:
        """The rows whose line no run has in at least `least` documents: an anti-join with each run in turn."""
        for run in [r for level in self.levels for r in level]:
            known = self._table(run).read().where(F.col("n") >= least)
            counts = counts.join(known.hint("merge"), KEYS, "left_anti")
        return counts

    def add(self, counts: DataFrame) -> None:
        """One batch as a new run at level 0; full levels are merged into the next."""
        self._write(0, counts)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(level + 1, self.counts(old))
            self._save()
            for run in old:
                self._table(run).drop()
            level += 1
        self._save()


def drop_lines(
    docs: DataFrame, drops: DataFrame, text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """Columns n_lines, n_dropped, kept_text and those of `carry`: each text without the lines whose
    hashes are in `drops` (h1, h2, stored).

    Only hashes and line numbers are shuffled to find the lines; texts move once, to meet their
    list of line numbers, which is at most as long as the document. A line that very many
    documents hold is a hot join key, which Spark splits at run time."""
    rows = numbered(docs, text, carry)
    keys = F.transform(lines_of(F.col("text")), key_of)
    places = rows.select("row", F.posexplode(keys).alias("pos", "key")).where("key <> ''")
    hit = hashed(places, "row", "pos").join(drops.select(*KEYS), KEYS, "left_semi")
    hits = hit.groupBy("row").agg(F.collect_list("pos").alias("gone"))
    both = rows.join(hits, "row", "left").withColumn("lines", lines_of(F.col("text")))
    size = F.size("lines")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), size - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return both.select(
        *carried(carry), size.cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"),
        F.when(F.size(gone) == 0, F.col("text")).otherwise(kept).alias("kept_text"),
    )


def drop_frequent(
    docs: DataFrame, runs: LineRuns, min_docs: int = 10, text: str = "text", carry: Sequence[str] = (), batches: int = 1
) -> DataFrame:
    """Add the rows to the runs in `batches`, then drop from their texts all lines that at least
    `min_docs` documents of all runs hold. Null text is the empty text, with one empty line; empty keys
    are never dropped. Rows repeat as they come, each counting as a document; no rows give no rows.
    Two keys are taken as equal when both 64-bit hashes agree.

    A line that one run alone shows to be frequent need not be counted further: the anti-join takes it
    out of later batches. All other counts are kept and summed, so the result is exact for this
    `min_docs`; runs filled so tell which lines are frequent, not how often those are."""
    for counts in batch_counts(docs, batches, text):
        runs.add(runs.unseen(counts, min_docs))
    frequent = stored(runs.counts().where(F.col("n") >= min_docs).select(*KEYS), "frequent-lines")
    return drop_lines(docs, frequent, text, carry)


def drop_seen(docs: DataFrame, runs: LineRuns, text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Drop the lines that earlier batches hold, then add the batch to the runs. Cases as in
    `drop_frequent`; a line that only this batch holds stays wherever it stands."""
    batch = stored(line_counts(docs, text), "line-batch")
    fresh = runs.unseen(batch)
    known = stored(batch.join(fresh.select(*KEYS), KEYS, "left_anti").select(*KEYS), "known-lines")
    runs.add(batch)
    return drop_lines(docs, known, text, carry)


def op10_levelled_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    runs = LineRuns(spark, scratch_path(spark, "line-runs"))
    found = drop_frequent(docs, runs, 10, carry=["doc_id"], batches=5)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = """
with lines as (
  select doc_id, i, l, trim(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
often as (select k from lines where k <> '' group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(l, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from (select *, k in (select k from often) as gone from lines) group by doc_id
"""

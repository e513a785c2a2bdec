"""Session settings the plans rely on, and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE splits a hot join partition; the force flag lets it do so even where the split costs a
# further exchange, as it does under a grouping on the same key. Small partitions may stay apart,
# since a row costs more here than its bytes suggest. Lists are gathered for many small groups,
# which stay in the hash table up to the threshold.
# A task's memory is a multiple of what it fetches, about forty times as much in matching, where
# narrow rows compress well. So the exchanges start with many partitions, which AQE joins up to a
# few megabytes: more input makes more tasks and not larger ones.
# A method above 8,000 bytes is never compiled by the JVM, so Spark is to split such stages.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8192",
}


# Only at the start of a session: without call sites in error texts, plans are built faster.
STARTUP = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder, or a new one in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="inputtrace-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

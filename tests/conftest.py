import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from inputtrace.session import STARTUP, tune

    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    for name, value in STARTUP.items():
        builder = builder.config(name, value)
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    session = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", folder)
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()

"""The queries over rows of their own, planned as over large tables.

No side of a join is broadcast there, so every side is read; and long stages are not compiled as a whole,
so a filter computes what its conditions have in common before it asks any of them."""

import datetime

import pytest

from __spark_entry__ import queries

CLIPPED = {
    "coalesce_actions": [(7, 0, 2, "F00"), (7, 0, 13, "F01"), (7, 0, 29, "F12")],
    "coalesce_report": [("val", 1, 4, 3, 0, 25.0)],
    "drop_empty_clips": [(7, 0, 3)],
}


PLANNED = {"spark.sql.codegen.wholeStage": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def large(spark):
    before = {name: spark.conf.get(name) for name in PLANNED}
    for name, value in PLANNED.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("name", CLIPPED)
def test_predictions_before_the_first_frame(large, tmp_path, name):
    """Event 5 is predicted at frame -2, whose label F-1 has no number; event 17 has no time, so its label
    has none either; event 14 repeats event 13."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(days=d), 7, "x", 0.0, '{"k": 1}') for i, d in ((2, 0), (5, 0), (13, 0), (14, 0), (29, 2))]
    rows.append((17, None, 7, "x", 0.0, '{"k": 1}'))
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    large.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = queries()[name](large, str(tmp_path)).collect()
    assert sorted(tuple(row)[: len(CLIPPED[name][0])] for row in found) == CLIPPED[name]

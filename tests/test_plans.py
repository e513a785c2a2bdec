"""Whole jobs."""

import json

import simulate
from pyspark.sql import functions as F
from inputtrace.plans.training import score_results, training_clips
from inputtrace.sources import files
from inputtrace.sources.schemas import LOG


def test_training_clips(spark):
    log = simulate.random_log(21, recordings=6, rows=40)
    frames = [(f"r{r}", f, 1.0 if f % 7 == 3 else 0.0) for r in range(6) for f in range(40 if r != 5 else 0)]
    table = spark.createDataFrame(frames, "recording_id string, frame_idx int, black_fraction double")
    settings = dict(fps=10, clip_length=10, clip_stride=5, min_actions=1, train_ratio=0.5)
    clips = training_clips(spark.createDataFrame(log, LOG), table, keep_empty_ratio=1.0, **settings).collect()

    kept = [f for f in range(40) if f % 7 != 3]
    wanted = {}
    for rec in ("r0", "r1", "r2", "r3", "r4"):
        for chunk, start in enumerate(range(0, len(kept) - 10 + 1, 5)):
            wanted[rec, chunk] = []
    for rec, frame, kind, details in simulate.training_actions(log, 10, 40):
        if rec == "r5" or frame not in kept:
            continue
        for chunk, start in enumerate(range(0, len(kept) - 10 + 1, 5)):
            if 0 <= kept.index(frame) - start < 10:
                wanted[rec, chunk].append((f"F{kept.index(frame) - start:02d}", kind, details))
    found = {(c.recording_id, c.chunk): [(a.frame, a.type, a.details) for a in c.actions] for c in clips}
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in wanted.items()}
    assert all([a[:2] for a in v] == sorted(a[:2] for a in v) for v in found.values())
    assert {c.num_frames for c in clips} == {10}
    assert len({(c.recording_id, c.split) for c in clips}) == 5
    assert all(c.clip_dir == f"{c.split}/{c.clip_id}" and c.clip_id == f"{c.recording_id}_c{c.chunk:03d}" for c in clips)

    dropped = training_clips(spark.createDataFrame(log, LOG), table, keep_empty_ratio=0.0, **settings).collect()
    assert {(c.recording_id, c.chunk) for c in dropped} == {k for k, v in wanted.items() if v}


def test_score_results(spark, tmp_path):
    def press(ts, name, kind="KeyPress"):
        return [ts, [kind, [1, name]]]

    truth = [press(1_500_000, "KeyA"), press(1_600_000, "KeyA", "KeyRelease"), [2_000_000, ["MouseScroll", [0, -1, 0, 0]]], [2_400_000, ["MouseScroll", [0, -1, 0, 0]]]]
    said = [{"frame": "F01", "type": "KeyPress", "details": "a"}, {"frame": "F02", "type": "MouseScroll", "details": "Down"}, {"frame": "F09", "type": "MouseClick", "details": "Left"}]
    clips = [
        {"clip_index": 0, "clip_name": "c", "tag": "t", "start_s": 1.0, "ground_truth": truth, "predictions": said},
        {"clip_index": 1, "clip_name": "d", "tag": "t", "start_s": 0.0, "ground_truth": [], "predictions": []},
    ]
    path = tmp_path / "results.json"
    path.write_text(json.dumps({"model_id": "m", "fps": 2, "tolerance": 2, "coalesce": True, "clips": clips}))
    results = files.read_results(spark, str(path))
    plain = {(r.level, r.clip_index, r.type): (r.tp, r.fp, r.fn) for r in score_results(results).collect()}
    assert plain["overall", None, None] == (2, 1, 1) and plain["clip", 1, None] == (0, 0, 0)
    assert plain["type", None, "MouseScroll"] == (1, 0, 1)
    merged = {(r.level, r.clip_index, r.type): (r.tp, r.fp, r.fn) for r in score_results(results, coalesce=True).collect()}
    assert merged["overall", None, None] == (2, 1, 0)


def test_index_plans(spark):
    import random

    from inputtrace.operators.reports import coalesce_report
    from inputtrace.plans.index import coalesce_index, drop_empty, subsample_index

    rnd = random.Random(8)
    kinds = [("MouseScroll", "up"), ("MouseScroll", "down"), ("MouseClick", "Left"), ("KeyPress", "A")]
    lists = [[(rnd.randrange(25), *rnd.choice(kinds)) for _ in range(n)] for n in (0, 1, 30, 60)]
    rows = [(f"c{i}", 25, 5, [(f"F{f:02d}", t, d) for f, t, d in a], "train") for i, a in enumerate(lists)]
    schema = "clip_id string, num_frames int, fps int, actions array<struct<frame:string,type:string,details:string>>, split string"
    merged = coalesce_index(spark.createDataFrame(rows, schema))
    for row in merged.orderBy("clip_id").collect():
        given = lists[int(row.clip_id[1:])]
        found = [(int(a.frame[1:]), a.type, a.details) for a in row.actions]
        assert sorted(found) == simulate.merged(given)
        rank = {"KeyPress": 0, "MouseScroll": 1, "MouseClick": 2}
        assert [(f, rank[t]) for f, t, _ in found] == sorted((f, rank[t]) for f, t, _ in found)
    report = coalesce_report(merged).first()
    assert (report.clips, report.before, report.empty_clips) == (4, 91, 1)
    assert drop_empty(merged).count() == 3
    moved = subsample_index(merged).orderBy("clip_id").collect()[3]
    assert (moved.num_frames, moved.fps) == (10, 2) and all(int(a.frame[1:]) < 10 for a in moved.actions)


def test_pixels_are_read_once(spark):
    from __spark_entry__ import queries

    plan = queries()["chunk_clips"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_truth_is_made_once(spark):
    """Merging reads truth for its rows and for the sums of hot slices, and a sweep no more than that;
    besides, the log is counted and the predictions are read."""
    from __spark_entry__ import queries

    def scans(name):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Relation [")

    alone = scans("gt_actions")
    assert scans("coalesce_gt") <= 2 * alone + 2
    assert scans("rescore_sweep") <= 2 * alone + 3


def test_more_input_makes_more_tasks_and_not_larger_ones(spark):
    from pyspark.sql import functions as F

    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    rows = spark.range(3_000_000).select("id", F.xxhash64("id").alias("h"))
    dealt = rows.groupBy("h").agg(F.max("id").alias("id"))
    assert dealt.rdd.getNumPartitions() > 8


def test_paths_are_made_and_parsed_once(spark):
    """Conditions that Spark moves below a projection must not repeat what it computes."""
    from inputtrace.sources.files import pair_recordings

    rows = spark.range(6).withColumn("s", F.substring(F.md5(F.col("id").cast("string")), 1, 8))
    videos = rows.select(F.concat(F.lit("/d/recordings/recording_"), "s", F.lit("_seg0007.mp4")).alias("path"))
    logs = rows.where("id > 1").select(F.concat(F.lit("/d/keylogs/input_"), "s", F.lit("_seg0007.msgpack")).alias("path"))
    pairs = pair_recordings(videos, logs)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 2 and plan.count("regexp_extract(") == 4
    assert {(r["seg"], r["suffix"]) for r in pairs.collect()} == {(7, "")} and pairs.count() == 4

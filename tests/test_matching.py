"""Matching and scores."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import simulate
from inputtrace.operators import matching, scoring

ACTIONS = "recording_id string, pos bigint, frame int, type string, detail string"


def table(spark, rows, clip="r"):
    return spark.createDataFrame([(clip, i, *row) for i, row in enumerate(rows)], ACTIONS)


K, C = "KeyPress", "MouseClick"
CASES = [
    ([(3, K, "A")], [(3, K, "A")], 2, (1.0, 1.0, 1.0)),
    ([(3, K, "A")], [(5, K, "A")], 2, (1.0, 1.0, 1.0)),
    ([(3, K, "A")], [(6, K, "A")], 2, (0.0, 0.0, 0.0)),
    ([(3, K, "A")], [(3, C, "Left")], 2, (0.0, 0.0, 0.0)),
    ([], [], 2, (1.0, 1.0, 1.0)),
    ([(3, K, "A")], [], 2, (0.0, 0.0, 0.0)),
    ([], [(3, K, "A")], 2, (0.0, 0.0, 0.0)),
    ([(3, K, "A"), (10, C, "Left")], [(3, K, "A"), (20, K, "B")], 2, (0.5, 0.5, 0.5)),
    ([(3, K, "A"), (5, K, "B"), (10, C, "Left")], [(3, K, "A"), (5, K, "B"), (10, C, "Left")], 2, (1.0, 1.0, 1.0)),
    ([(5, K, "A")], [(5, K, "A"), (6, K, "B")], 2, (0.5, 1.0, 2 / 3)),
]


@pytest.mark.parametrize("truth,preds,tolerance,expected", CASES)
def test_compute_f1(spark, truth, preds, tolerance, expected):
    clips = spark.createDataFrame([("r",)], "recording_id string")
    row = matching.compute_f1(table(spark, truth), table(spark, preds), clips, ["recording_id"], tolerance).first()
    assert (row.precision, row.recall, row.f1) == pytest.approx(expected)


def _random(seed, groups, ordered):
    rnd = random.Random(seed)
    truth, preds = {}, {}
    for g in range(groups):
        for side in (truth, preds):
            rows = [(rnd.randrange(25), K, rnd.choice("AB")) for _ in range(rnd.randrange(14))]
            side[f"g{g}"] = sorted(rows, key=lambda r: r[0]) if ordered else rows
    return truth, preds


def _frame(spark, side):
    rows = [(g, i, *row) for g, listed in side.items() for i, row in enumerate(listed)]
    return spark.createDataFrame(rows, ACTIONS)


@pytest.mark.parametrize("tolerance", [0, 1, 2, 5])
def test_match_clip_random(spark, tolerance):
    truth, preds = _random(tolerance, 150, True)
    found = matching.match_clip(_frame(spark, truth), _frame(spark, preds), ["recording_id"], tolerance).collect()
    pairs, left, spare = [], [], []
    for r in found:
        if r.outcome == "match":
            pairs.append((r.recording_id, r.gt_frame, r.pred_frame, r.type, r.detail))
            assert r.frame_dist == abs(r.gt_frame - r.pred_frame)
        else:
            (left if r.outcome == "unmatched_gt" else spare).append(r)
    wanted = [(g, *p) for g in truth for p in simulate.greedy(truth[g], preds[g], tolerance)]
    assert sorted(pairs) == sorted(wanted)
    assert len(left) == sum(map(len, truth.values())) - len(wanted)
    assert len(spare) == sum(map(len, preds.values())) - len(wanted)


@pytest.mark.parametrize("tolerance", [1, 3])
def test_match_lists_random(spark, tolerance):
    truth, preds = _random(10 + tolerance, 150, False)
    solved = matching.match_lists(_frame(spark, truth), _frame(spark, preds), ["recording_id"], tolerance)
    pairs = sorted(
        (r.recording_id, p.frame, p.pred_frame, r.type, r.detail)
        for r in solved.collect() for p in r.picks for _ in range(p.n)
    )
    assert pairs == sorted((g, *p) for g in truth for p in simulate.greedy(truth[g], preds[g], tolerance))


def test_take_in_order_is_linear_in_a_long_stretch():
    import time

    rnd = random.Random(8)
    asked, given = ([rnd.randrange(60_000) for _ in range(100_000)] for _ in range(2))
    start = time.perf_counter()
    picks = matching.take_in_order(asked, [1] * len(asked), given, [1] * len(given), 2)
    assert time.perf_counter() - start < 10
    for side, place in ((asked, 0), (given, 1)):
        used = collections.Counter()
        for pick in picks:
            used[pick[place]] += pick[2]
        assert not used - collections.Counter(side)
    truth, preds = [(f, K, "A") for f in asked[:1500]], [(f % 900, K, "A") for f in given[:1500]]
    truth = [(f % 900, *rest) for f, *rest in truth]
    some = matching.take_in_order([t[0] for t in truth], [1] * 1500, [p[0] for p in preds], [1] * 1500, 2)
    assert sorted((*p[:2], K, "A") for p in some for _ in range(p[2])) == simulate.greedy(truth, preds, 2)


def test_actions_without_frame_meet_nothing(spark):
    truth, preds = [(None, K, "A"), (3, K, "A"), (3, K, "A")], [(None, K, "A"), (4, K, "A")]
    clips = spark.createDataFrame([("r",)], "recording_id string")
    row = matching.compute_f1(table(spark, truth), table(spark, preds), clips, ["recording_id"]).first()
    assert (row.tp, row.fp, row.fn) == (1, 1, 2)


def test_long_stretch_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 7)
    rnd = random.Random(3)
    truth = [(f, K, "A") for f in range(120) for _ in range(rnd.randrange(3))]
    preds = [(f, K, "A") for f in range(120) for _ in range(rnd.randrange(3))]
    found = matching.match_clip(table(spark, truth), table(spark, preds), ["recording_id"], 2)
    pairs = sorted((r.gt_frame, r.pred_frame, K, "A") for r in found.collect() if r.outcome == "match")
    assert pairs == simulate.greedy(truth, preds, 2)


def test_many_copies_of_one_action(spark):
    truth, preds = [(4, K, "A")] * 500, [(5, K, "A")] * 300 + [(3, K, "A")] * 100
    counts = matching.outcome_counts(
        matching.match_frames(table(spark, truth), table(spark, preds), ["recording_id"], 1), ["recording_id"]
    ).first()
    assert (counts.tp, counts.fp, counts.fn) == (400, 0, 100)


def test_rollup_levels(spark):
    clips = spark.createDataFrame([("r",), ("silent",)], "recording_id string")
    truth, preds = table(spark, [(3, K, "A"), (9, C, "Left")]), table(spark, [(3, K, "A"), (4, K, "B")])
    rows = {(r.level, r.recording_id, r.type): r for r in scoring.score(truth, preds, clips, ["recording_id"]).collect()}
    assert set(rows) == {
        ("overall", None, None), ("type", None, K), ("type", None, C), ("clip", "r", None), ("clip", "silent", None)
    }
    whole = rows["overall", None, None]
    assert (whole.tp, whole.fp, whole.fn, whole.gt_count, whole.pred_count) == (1, 1, 1, 2, 2)
    assert (rows["type", None, C].fn, rows["type", None, C].fp) == (1, 0)
    silent = rows["clip", "silent", None]
    assert (silent.tp, silent.fp, silent.fn, silent.f1) == (0, 0, 0, 0.0)


def test_sweep_agrees_with_single_runs(spark):
    from pyspark.sql import functions as F
    from inputtrace.operators.gestures import coalesce_gt

    rnd = random.Random(5)
    kinds = [("MouseScroll", "up"), ("MouseScroll", "down"), (C, "Left"), (K, "A")]
    rows = [sorted((rnd.randrange(30), *rnd.choice(kinds)) for _ in range(60)) for _ in range(2)]
    seq = F.struct(F.col("pos").alias("ts_us"), F.col("pos").alias("ord"))
    truth, preds = table(spark, rows[0]).withColumn("seq", seq), table(spark, rows[1])
    clip = ["recording_id"]
    swept = {(r.tolerance, r.coalesce): (r.tp, r.fp, r.fn) for r in scoring.rescore_sweep(truth, preds, clip, [0, 3]).collect()}
    for (tolerance, merged), counts in swept.items():
        side = coalesce_gt(truth, clip) if merged else truth
        one = matching.outcome_counts(matching.match_frames(side, preds, clip, tolerance), clip).first()
        assert (one.tp, one.fp, one.fn) == counts
    assert len(swept) == 4


def test_what_is_gathered_for_matching_has_no_candidates(spark):
    """Counts are gathered per stretch; what is in reach of each frame is looked up afterwards."""
    solved = matching.match_frames(table(spark, [(3, K, "A")]), table(spark, [(4, K, "A")]), ["recording_id"], 2)
    plan = solved._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.splitlines() if "Aggregate [" in line and "collect_list" in line]
    assert len(gathered) == 1 and "pred_frame" not in gathered[0]


def test_sweep_over_stretches_that_merging_changes_or_not(spark):
    from pyspark.sql import functions as F
    from inputtrace.operators.gestures import mark_gt

    rnd = random.Random(11)
    kinds = [("MouseScroll", "up"), (C, "Left"), (K, "A"), (K, "B")]
    starts = [0, 40, 90, 200]
    rows = [sorted((rnd.choice(starts) + rnd.randrange(9), *rnd.choice(kinds)) for _ in range(80)) for _ in range(2)]
    seq = F.struct(F.col("pos").alias("ts_us"), F.col("pos").alias("ord"))
    truth, preds = table(spark, rows[0]).withColumn("seq", seq), table(spark, rows[1])
    clip = ["recording_id"]
    marked = mark_gt(truth, clip).cache()
    kept = [(r.frame, r.type, r.detail) for r in marked.where("kept").orderBy("frame", "pos").collect()]
    found = scoring.rescore_sweep(truth, preds, clip, [0, 2, 5]).collect()
    assert sorted((r.tolerance, r.coalesce) for r in found) == [(t, m) for t in (0, 2, 5) for m in (False, True)]
    for r in found:
        side = kept if r.coalesce else rows[0]
        assert r.tp == len(simulate.greedy(side, rows[1], r.tolerance))
        assert (r.gt_count, r.pred_count) == (len(side), len(rows[1]))


def test_no_fold_where_nothing_competes(spark, monkeypatch):
    monkeypatch.setattr(matching, "_picks", lambda entries, reach: F.raise_error(F.lit("folded")).cast(matching.PICKS))
    schema = "c int, type string, detail string, frame int"
    truth = spark.createDataFrame([(1, "K", "a", 3), (1, "K", "a", 3), (1, "K", "a", 30), (2, "K", "b", 8), (2, "K", "b", 9)], schema)
    preds = spark.createDataFrame([(1, "K", "a", 4), (1, "K", "a", 50), (2, "K", "b", 9), (2, "K", "b", 8)], schema)
    found = {(r["c"], r["gt_count"]): [tuple(p) for p in r["picks"]] for r in matching.match_frames(truth, preds, ["c"], 2).where("c = 1").collect()}
    assert found == {(1, 2): [(3, 4, 4, 1)], (1, 1): [], (1, 0): []}
    exact = matching.match_frames(truth, preds, ["c"], 0).where("c = 2 and gt_count > 0").collect()
    assert sorted(tuple(p) for r in exact for p in r["picks"]) == [(8, 8, 8, 1), (9, 9, 9, 1)]

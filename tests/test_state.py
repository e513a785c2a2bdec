"""Logs to actions: literal cases, and random logs against the row-at-a-time model."""

import pytest

import simulate
from inputtrace.operators import gestures, spans
from inputtrace.plans.keylog import gt_actions, parse_keylog
from inputtrace.sources.schemas import LOG


def log(spark, *rows):
    """Rows (ts_us, etype, name or deltas)."""
    full = []
    for i, (ts, etype, what) in enumerate(rows):
        dx, dy = what if isinstance(what, tuple) else (0.0, 0.0)
        name = what if isinstance(what, str) else None
        full.append(("r", i, ts, etype, name, name, float(dx), float(dy), what == "UNCAPTURED"))
    return spark.createDataFrame(full, LOG)


def actions(spark, *rows, fps=10, frames=10, **kw):
    found = parse_keylog(log(spark, *rows), fps, frames, **kw)
    return sorted((r.frame_idx, r.type, r.details) for r in found.collect())


def presses(frames, details):
    return [(f, "KeyPress", details) for f in frames]


CASES = {
    "press": ([(500_000, "KeyPress", "KeyA"), (600_000, "KeyRelease", "KeyA")], presses([5], "A")),
    "combination": (
        [(100_000, "KeyPress", "MetaLeft"), (200_000, "KeyPress", "KeyC"), (300_000, "KeyRelease", "KeyC")],
        presses([2], "Cmd+C"),
    ),
    "modifier alone": ([(100_000, "KeyPress", "ShiftLeft"), (200_000, "KeyRelease", "ShiftLeft")], []),
    "click": ([(200_000, "MousePress", "Left"), (210_000, "MouseRelease", "Left")], [(2, "MouseClick", "Left")]),
    "drag": ([(500_000, "MousePress", "Right")], [(5, "MouseClick", "Right")]),
    "horizontal": ([(300_000, "MouseScroll", (-1, 0))], [(3, "MouseScroll", "down")]),
    "vertical": ([(300_000, "MouseScroll", (0, -1))], [(3, "MouseScroll", "down")]),
    "move": ([(300_000, "MouseMove", None)], []),
    "outside": ([(9_999_999, "KeyPress", "KeyA")], []),
    "frames": ([(150_000, "KeyPress", "KeyB"), (160_000, "KeyRelease", "KeyB")], presses([1], "B")),
    "no scroll": ([(300_000, "MouseScroll", (0, 0))], []),
    "never released": ([(500_000, "KeyPress", "KeyA")], presses(range(5, 9), "A")),
    "last frame": ([(900_000, "KeyPress", "KeyA")], presses([9], "A")),
    "two taps": (
        [(500_000, "KeyPress", "KeyA"), (510_000, "KeyRelease", "KeyA"), (520_000, "KeyPress", "KeyA"), (530_000, "KeyRelease", "KeyA")],
        presses([5, 5], "A"),
    ),
    "late release": ([(700_000, "KeyPress", "KeyA"), (1_500_000, "KeyRelease", "KeyA")], presses([7, 8], "A")),
    "context": (
        [(200_000, "KeyPress", "ShiftLeft"), (210_000, "KeyPress", "KeyA"), (400_000, "ContextChanged", "UNCAPTURED"), (600_000, "KeyPress", "KeyB"), (700_000, "KeyRelease", "KeyB")],
        presses([2, 3], "Shift+A") + presses([6], "B"),
    ),
    "other context": ([(200_000, "KeyPress", "KeyA"), (400_000, "ContextChanged", "Mail"), (500_000, "KeyRelease", "KeyA")], presses([2, 3, 4], "A")),
    "net zero": ([(100_000, "MouseScroll", (0, 1)), (200_000, "MouseScroll", (0, -1))], []),
    "zero bridges": (
        [(100_000, "MouseScroll", (0, 1)), (200_000, "MouseScroll", (0, 1)), (210_000, "MouseScroll", (0, -1)), (300_000, "MouseScroll", (0, 1))],
        [(1, "MouseScroll", "up")],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_parse_keylog_cases(spark, name):
    rows, expected = CASES[name]
    assert actions(spark, *rows) == sorted(expected)


def test_action_types(spark):
    rows = [(100_000, "MousePress", "Left"), (200_000, "KeyPress", "KeyA"), (250_000, "KeyRelease", "KeyA"), (300_000, "MouseScroll", (0, 1))]
    assert [a[1] for a in actions(spark, *rows, action_types="keyboard")] == ["KeyPress"]
    assert [a[1] for a in actions(spark, *rows, action_types="keyboard,click")] == ["MouseClick", "KeyPress"]
    assert len(actions(spark, *rows)) == 3
    with pytest.raises(ValueError):
        actions(spark, *rows, action_types="mouse")


def test_num_frames_as_column(spark):
    from pyspark.sql import functions as F

    given = log(spark, (500_000, "KeyPress", "KeyA"), (300_000, "MouseScroll", (0, 1))).withColumn("num_frames", F.lit(8))
    found = parse_keylog(given, 10)
    assert sorted((r.frame_idx, r.details) for r in found.collect()) == [(3, "up"), (5, "A"), (6, "A")]


@pytest.mark.parametrize("seed,hot_rows", [(1, 10**6), (2, 40), (3, 100)])
def test_random_logs(spark, seed, hot_rows):
    rows = simulate.random_log(seed)
    df = spark.createDataFrame(rows, LOG)
    found = sorted((r.recording_id, r.frame_idx, r.type, r.details) for r in parse_keylog(df, 10, 40, hot_rows=hot_rows).collect())
    assert found == simulate.training_actions(rows, 10, 40)


@pytest.mark.parametrize("seed,hot_rows", [(4, 10**6), (5, 40)])
def test_random_truth(spark, seed, hot_rows):
    from pyspark.sql import functions as F

    rows = simulate.random_log(seed)
    df = spark.createDataFrame(rows, LOG).withColumn("start_s", F.lit(0.25))
    truth = gt_actions(df, 10, hot_rows=hot_rows)
    expected = simulate.truth_actions(rows, 0.25, 10)
    assert sorted((r.recording_id, r.frame, r.type, r.detail) for r in truth.collect()) == sorted(expected)

    merged = gestures.coalesce_gt(truth, ["recording_id"], hot_rows=hot_rows)
    wanted = []
    for rec in {e[0] for e in expected}:
        wanted += [(rec, *a) for a in simulate.merged([e[1:] for e in expected if e[0] == rec])]
    assert sorted((r.recording_id, r.frame, r.type, r.detail) for r in merged.collect()) == sorted(wanted)


def _slices(df, hot_rows):
    """Slices of the recording ``big`` in order, checked to follow it; those of others must not exist."""
    from inputtrace.operators.scan import FINE, SLICE, split_hot

    cut = split_hot(df, ["recording_id"], hot_rows=hot_rows).orderBy("recording_id", "ts_us", "ord").collect()
    assert all(r[SLICE] is None for r in cut if r.recording_id != "big")
    numbers = [(r[SLICE], *r[FINE]) for r in cut if r.recording_id == "big"]
    assert len(cut) == df.count() and numbers == sorted(numbers)
    return [numbers.count(n) for n in sorted(set(numbers))]


LOGGED = "recording_id string, ord bigint, ts_us bigint"


@pytest.mark.parametrize(
    "times",
    [
        [i // 3 for i in range(3000)],  # all in one second
        [i * 50_000 for i in range(3000)],  # spread
        [7] * 3000,  # one microsecond
        [i * 900_000 for i in range(1000)] + [5_000_000 + i for i in range(1000)] + [5_000_100] * 1000,  # all of these
    ],
)
def test_hot_group_is_cut_in_order(spark, times):
    rows = [("big", (i * 7) % 3000, t) for i, t in enumerate(times)] + [("small", i, i) for i in range(300)]
    sizes = _slices(spark.createDataFrame(rows, LOGGED), 300)
    assert len(sizes) >= 8 and max(sizes) <= 600


def test_slicing_needs_no_job_and_falls_away(spark):
    from inputtrace.operators.scan import split_hot

    df = spark.createDataFrame([("r", i, i) for i in range(50)], LOGGED)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "plan only")
    cut = split_hot(df, ["recording_id"])
    assert not tracker.getJobIdsForGroup("planning")
    rows = spans.state_rows(spans.in_frames(log(spark, (510_000, "KeyPress", "KeyA"), (520_000, "KeyRelease", "KeyA")), 10, 10))
    held = spans.hold_spans(split_hot(rows, ["recording_id"]))
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert cut.count() == 50
    held.collect()
    assert len(held.collect()) == 1
    final = held._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in final.split("Final Plan")[-1]


@pytest.mark.parametrize("one_instant", [False, True])
def test_hot_recording_against_model(spark, one_instant):
    """Nine in ten rows in one recording; and all its rows in one microsecond."""
    rows = [r for r in simulate.random_log(7)]
    big = max({r[0] for r in rows}, key=lambda rec: sum(r[0] == rec for r in rows))
    rows = [r for r in rows if r[0] == big] + [r for r in rows if r[0] != big][:12]
    if one_instant:
        rows = [(r[0], r[1], 300_000, *r[3:]) if r[0] == big else r for r in rows]
    df = spark.createDataFrame(rows, LOG)
    found = sorted((r.recording_id, r.frame_idx, r.type, r.details) for r in parse_keylog(df, 10, 40, hot_rows=9).collect())
    assert found == simulate.training_actions(rows, 10, 40)


def _listed(spark, rows):
    full = [("r", i, *row) for i, row in enumerate(rows)]
    return spark.createDataFrame(full, "recording_id string, pos bigint, frame_idx int, type string, details string")


S = "MouseScroll"


@pytest.mark.parametrize(
    "rows,kept",
    [
        ([(0, S, "down"), (1, S, "down"), (2, S, "down")], [0]),
        ([(0, S, "down"), (1, S, "down"), (2, S, "up"), (3, S, "up")], [0, 2]),
        ([(0, S, "down"), (5, S, "down")], [0, 1]),
        ([(0, "KeyPress", "A"), (1, S, "down"), (2, S, "down"), (5, "MouseClick", "Left")], [0, 1, 3]),
        ([(0, S, "down"), (0, "KeyPress", "A"), (1, S, "down")], [0, 1, 2]),
    ],
)
@pytest.mark.parametrize("hot_rows", [10**6, 1])
def test_coalesce_scroll_list(spark, rows, kept, hot_rows):
    found = gestures.coalesce_scroll_list(_listed(spark, rows), ["recording_id"], hot_rows=hot_rows)
    assert sorted(r.pos for r in found.collect()) == kept


@pytest.mark.parametrize("hot_rows", [10**6, 5])
def test_coalesce_repeats(spark, hot_rows):
    import random

    rnd = random.Random(9)
    kinds = [(S, "up"), (S, "down"), ("MouseClick", "Left"), ("MouseClick", "Right"), ("KeyPress", "A")]
    rows = [(rnd.randrange(20), *rnd.choice(kinds)) for _ in range(80)]
    found = gestures.coalesce_repeats(_listed(spark, rows), ["recording_id"], "frame_idx", hot_rows=hot_rows)
    assert sorted((r.frame_idx, r.type, r.details) for r in found.collect()) == simulate.merged(rows)
    again = gestures.coalesce_repeats(found, ["recording_id"], "frame_idx", hot_rows=hot_rows)
    assert again.count() <= found.count()


def test_spans_of_a_release_in_the_same_frame(spark):
    rows = spans.state_rows(spans.in_frames(log(spark, (510_000, "KeyPress", "KeyA"), (520_000, "KeyRelease", "KeyA")), 10, 10))
    held = spans.close_open_spans(spans.hold_spans(rows), 9).collect()
    assert [(h.start_frame, h.end_frame) for h in held] == [(5, 5)]

"""Names, labels, prompts, answers, tokens, clips and frame rates."""

import json

import pytest
from pyspark.sql import functions as F

from inputtrace.functions import frames as fn
from inputtrace.functions import names, text
from inputtrace.operators import clips, sampling, tokens


def values(spark, data, data_type, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {data_type}")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_key_names(spark):
    given = ["KeyA", "KeyZ", "Digit0", "MetaLeft", "ShiftRight", "ControlLeft", "AltGr", "Alt", "Return", "UpArrow", "F12", "SomeWeirdKey", "KeyAB"]
    shown = ["A", "Z", "0", "Cmd", "Shift", "Ctrl", "AltGr", "Alt", "Return", "UpArrow", "F12", "SomeWeirdKey", "KeyAB"]
    assert values(spark, given, "string", names.normalize_key) == shown


@pytest.mark.parametrize(
    "key,held,expected",
    [("A", (), "A"), ("C", ("Cmd",), "Cmd+C"), ("Z", ("Cmd", "Shift"), "Cmd+Shift+Z"), ("Shift", ("Shift",), "Shift"),
     ("A", ("Shift", "Cmd", "Ctrl", "Alt"), "Cmd+Ctrl+Alt+Shift+A")],
)
def test_combinations(spark, key, held, expected):
    flags = {m: F.lit(m in held) for m in names.SHOWN_MODIFIERS}
    assert values(spark, [key], "string", lambda c: names.format_combo(c, flags)) == [expected]


def test_predicted_names(spark):
    given = ["enter", " a ", "cmd+c", "Up", "Ctrl + é", "F5", "", "command+shift+pageup"]
    assert values(spark, given, "string", names.normalize_pred_key) == ["Return", "A", "Cmd+C", "UpArrow", "Ctrl+É", "F5", "", "Cmd+Shift+PageUp"]


def test_training_names(spark):
    given = ["SemiColon", "Cmd+BackSlash", "Cmd++", "BackQuote", "A"]
    assert values(spark, given, "string", names.normalize_training_details) == ["Semicolon", "Cmd+Backslash", "Cmd++", "Backtick", "A"]


def test_labels(spark):
    assert values(spark, [3, 12, 123], "int", fn.frame_label) == ["F03", "F12", "F123"]
    assert values(spark, ["F07", " f7 ", "F+3", "7", "Fx", None, "F-2"], "string", fn.frame_of_prediction) == [7, 7, 3, -1, -1, -1, -2]
    assert values(spark, ["F07", "frame 12", "", None], "string", fn.frame_from_digits) == [7, 12, 0, 0]


def test_rounding(spark):
    half = values(spark, [50_000, 150_000, 250_000, -50_000, -60_000], "bigint", lambda c: fn.frame_round(c, F.lit(0.0), 10))
    assert half == [0, 2, 2, 0, -1]
    assert values(spark, [-1, 99_999, 100_000], "bigint", lambda c: fn.frame_floor(c, 10)) == [-1, 0, 1]


def test_prompt(spark):
    prompt = values(spark, [25], "int", lambda c: text.build_prompt(F.lit(5), c))[0]
    assert "5fps" in prompt and "200ms" in prompt and "25 frames total (F00 to F24)" in prompt
    assert '"frame": "F03"' in prompt and "SINGLE KEY" in prompt and "no markdown fences" in prompt
    assert "62ms" in values(spark, [3], "int", lambda c: text.build_prompt(F.lit(16), c))[0]


def test_messages(spark):
    paths = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    args = (paths, F.lit("hello"), F.lit("world"), F.lit(10))
    user, answer = values(spark, [0], "int", lambda _: text.build_messages(*args))[0]
    assert [c.type for c in user.content] == ["video", "text"] and user.content[0].video == ["a", "b", "c"]
    assert user.content[0].fps == 10.0 and user.content[1].text == "hello"
    assert answer.role == "assistant" and answer.content[0].text == "world"
    user, _ = values(spark, [0], "int", lambda _: text.build_messages(*args, "image"))[0]
    assert [c.image for c in user.content] == ["a", "b", "c", None]
    user, _ = values(spark, [0], "int", lambda _: text.build_messages(*args, "image", True))[0]
    assert [c.text for c in user.content] == ["Frame F00:", None, "Frame F01:", None, "Frame F02:", None, "hello"]


def test_target_is_ascii(spark):
    actions = F.array(F.struct(F.lit("F01").alias("frame"), F.lit("KeyPress").alias("type"), F.col("v").alias("details")))
    given = ["A", "é", "a😀b", "\\"]
    out = values(spark, given, "string", lambda _: text.target_json(actions))
    for value, written in zip(given, out):
        assert written == json.dumps([{"frame": "F01", "type": "KeyPress", "details": value}], separators=(",", ":"))


A = '{"frame":"F01","type":"KeyPress","details":"A"}'


@pytest.mark.parametrize(
    "answer,count",
    [
        (f"[{A}]", 1), (f"  [{A},{A}]  ", 2), ("[]", 0), ("", 0), (A, 0), (f"[{A}", 0), (f"[{A}] tail", 1),
        (f"```json\n[{A}]\n```", 1), (f"```\n[{A}]```", 1), (f"<think>[1]</think>[{A}]", 1), (f"<think>[{A}]", 0),
        (f"<|begin_of_box|>[{A}]<|end_of_box|>", 1), (f'say: [{A}] or [{A}]', 0), ("[{'frame': 'F01'}]", 0), ('[]} x {"b":1', 0), ("```json", 0), ("``````", 0),
        (f'{{"actions": [{A}]}}', 1), ("[\n" + A + ",\n" + A + "\n]", 2),
    ],
)
def test_parse_response(spark, answer, count):
    assert len(values(spark, [answer], "string", text.parse_response)[0]) == count


def test_resampling(spark):
    df = spark.createDataFrame([(25,), (1,), (30,)], "num_frames int")
    kept = clips.selected_frames(df).collect()
    assert [r.source_frame for r in kept if r.num_frames == 25] == [0, 3, 5, 8, 10, 13, 15, 18, 20, 23]
    assert [r.source_frame for r in kept if r.num_frames == 1] == [0]
    moved = clips.remap_actions(spark.createDataFrame([("F00", 25), ("F13", 25), ("F24", 25)], "frame string, num_frames int"))
    assert [(r.frame, r.num_frames) for r in moved.collect()] == [("F00", 10), ("F05", 10), ("F09", 10)]


@pytest.mark.parametrize(
    "n,length,stride,frames,clip_frames,placed",
    [
        (60, 30, 15, [5, 35], [30, 30, 30], [(0, 5), (1, 20), (2, 5)]),
        (10, 30, 15, [3], [10], [(0, 3)]),
        (30, 30, 15, [], [30], []),
        (90, 30, 30, [45], [30, 30, 30], [(1, 15)]),
        (30, 30, 30, [0, 29], [30], [(0, 0), (0, 29)]),
        (20, 5, 8, [4, 6, 9, 19], [5, 5], [(0, 4), (1, 1)]),
    ],
)
def test_chunking(spark, n, length, stride, frames, clip_frames, placed):
    whole = spark.createDataFrame([("r", n)], "recording_id string, num_frames int")
    windows = clips.clip_windows(whole, length, stride).orderBy("chunk").collect()
    assert [w.num_frames for w in windows] == clip_frames
    events = spark.createDataFrame([("r", f, n) for f in frames], "recording_id string, frame_idx int, num_frames int")
    found = clips.chunk_events(events, length, stride).collect()
    assert sorted((r.chunk, r.frame_idx) for r in found) == placed


def test_tokens(spark):
    given = [[1, 2, 3, 4, 1, 2], [5], [], [1, 2], [9, 1], [2, 1, 2, 8]]
    marker = [1, 2]
    prompt = lambda c: tokens.find_prompt_len(c, marker)
    assert values(spark, given, "array<int>", prompt) == [6, 0, 0, 2, 0, 3]
    labels = lambda c: tokens.mask_labels(c, prompt(c))
    assert values(spark, given, "array<int>", labels)[5] == [-100, -100, -100, 8]
    assert values(spark, given, "array<int>", lambda c: tokens.prompt_slice(c, labels(c)))[5] == [2, 1, 2]
    assert values(spark, given, "array<int>", lambda c: tokens.truncate_tokens(c, 2))[0] == [1, 2]


def test_collate(spark):
    df = spark.createDataFrame([(0, [1, 2], [-100, 2], [0, 1]), (0, [3], [3], [1]), (1, [4], [4], [0])], "batch_id int, ids array<int>, labels array<int>, mm array<int>")
    rows = tokens.collate_batch(df, pad_id=9, modality="mm").orderBy("batch_id", F.desc(F.col("ids")[0])).collect()
    assert [(r.ids, r.labels, r.attention_mask, r.mm) for r in rows] == [
        ([3, 9], [3, -100], [1, 0], [1, 0]), ([1, 2], [-100, 2], [1, 1], [0, 1]), ([4], [4], [1], [0])
    ]


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(101).withColumnRenamed("id", "recording_id").repartition(5)
    first = sampling.split_recordings(df, "recording_id", 0.85, 7)
    assert first.where("split = 'train'").count() == 85
    again = sampling.split_recordings(df.repartition(3), "recording_id", 0.85, 7)
    assert first.exceptAll(again).count() == 0
    assert first.exceptAll(sampling.split_recordings(df, "recording_id", 0.85, 8)).count() > 0


def test_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "clip_id").withColumn("n", F.col("clip_id") % 2)
    assert sampling.sample_negatives(df, "clip_id", "n", 1, 0.0).count() == 500
    assert 500 < sampling.sample_negatives(df, "clip_id", "n", 1, 0.1).count() < 600
    assert sampling.sample_negatives(df, "clip_id", "n", 1, 1.0).count() == 1000
    batches = sampling.assign_batches(df, "clip_id", 64).groupBy("batch_id").count().collect()
    assert len(batches) == 15 and {r["count"] for r in batches} == {64}
    shards = sampling.shard_clips(df, ["clip_id"], 3).collect()
    assert all(r.shard == r.clip_id % 3 for r in shards) and len(shards) == 1000
    assert sampling.first_recordings(df, "clip_id", 3).count() == 3
    assert sampling.first_recordings(df, "clip_id", 0).count() == 1000


@pytest.mark.parametrize("n,bounds", [(0, 15), (1, 15), (400, 7), (400, 4095)])
def test_ranks_in_order(spark, monkeypatch, n, bounds):
    import random

    from inputtrace.operators import ranking

    monkeypatch.setattr(ranking, "BOUNDS", bounds)
    rnd = random.Random(n)
    rows = list({(rnd.choice([None, "a", "b", "é"]), rnd.randrange(300)) for _ in range(n)})
    ranked = ranking.ordered_rank(spark.createDataFrame(rows, "k string, c int").repartition(5), ["k", "c"])
    found = sorted((r["rank"], r.k, r.c) for r in ranked.collect())
    wanted = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert found == [(i, *row) for i, row in enumerate(wanted, 1)]


def test_timing_median(spark):
    from inputtrace.operators.reports import timing_stats

    for data in ([3.0], [4.0, 1.0], [1.0, 2.0, 10.0], [2.0] * 50 + [7.0] * 51, [float(i) for i in range(1000)]):
        df = spark.createDataFrame([(x,) for x in data], "s double")
        assert timing_stats(df, "s").first().median_s == sorted(data)[len(data) // 2]


def test_predicted_keys_lose_all_white_space(spark):
    given = ["cmd+\tc", " a ", "\nenter", "shift + b"]
    assert values(spark, given, "string", names.normalize_pred_key) == ["Cmd+C", "A", "Return", "Shift+B"]

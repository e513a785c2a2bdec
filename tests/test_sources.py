"""Files: logs, listings, indexes, frames, result documents."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from inputtrace.operators import frames as FR
from inputtrace.operators.gestures import scroll_per_frame
from inputtrace.operators.spans import in_frames
from inputtrace.plans.keylog import gt_actions
from inputtrace.plans.training import score_results
from inputtrace.sources import files, keylog
from inputtrace.functions import text

LOG = [
    [500_000, ["KeyPress", [1, "KeyA"]]],
    [600_000.9, ["MousePress", ["Left", 1.0, 2.0]]],
    ["700000", ["MouseScroll", [0, -1, 3, 4]]],
    [800_000, ["ContextChanged", ["UNCAPTURED"]]],
    [True, ["MouseScroll", ["x", "y"]]],
    [None, ["KeyPress", [1, "KeyB"]]],
    ["soon", ["KeyPress", [1, "KeyB"]]],
    [900_000, []],
    [900_000, "KeyPress"],
    [900_000],
    {"ts": 1},
    "text",
    [950_000, ["KeyPress", [1]]],
    [960_000, ["KeyPress"]],
]
WANTED = [
    (0, 500_000, "KeyPress", "KeyA"), (1, 600_000, "MousePress", "Left"), (2, 700_000, "MouseScroll", -1.0),
    (3, 800_000, "ContextChanged", True), (4, 1, "MouseScroll", None), (12, 950_000, "KeyPress", None),
    (13, 960_000, "KeyPress", None),
]


def _check(rows):
    kinds = {"KeyPress": "raw_key", "MousePress": "button", "MouseScroll": "dy", "ContextChanged": "uncaptured"}
    assert sorted((r.ord, r.ts_us, r.etype, r[kinds[r.etype]]) for r in rows) == WANTED


def test_json_keylog(spark, tmp_path):
    (tmp_path / "log.json").write_text(json.dumps(LOG))
    _check(keylog.read_json_keylogs(spark, str(tmp_path)).collect())


def pack(value) -> bytes:
    """The few binary forms that logs use."""
    if value is None or isinstance(value, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[value]
    if isinstance(value, int):
        return bytes([value]) if 0 <= value < 128 else (bytes([value & 0xFF]) if -32 <= value < 0 else b"\xd3" + struct.pack(">q", value))
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else b"\xda" + struct.pack(">H", len(raw))) + raw
    if isinstance(value, dict):
        return bytes([0x80 | len(value)]) + b"".join(pack(k) + pack(v) for k, v in value.items())
    head = bytes([0x90 | len(value)]) if len(value) < 16 else b"\xdc" + struct.pack(">H", len(value))
    return head + b"".join(map(pack, value))


def test_binary_keylog(spark, tmp_path):
    (tmp_path / "a.msgpack").write_bytes(pack(LOG))
    (tmp_path / "b.msgpack").write_bytes(b"\xdc\x00\x10broken")
    (tmp_path / "c.msgpack").write_bytes(pack(LOG)[:-3])
    _check(keylog.read_binary_keylogs(spark, str(tmp_path)).collect())


@pytest.mark.parametrize("value", [0, 127, 128, -1, -32, -33, 2**40, 1.5, "é" * 40, [], list(range(20)), {"a": [None, True]}])
def test_unpack(value):
    assert keylog.unpack(pack(value)) == value


def test_recordings(spark, tmp_path):
    def touch(path):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x")

    for name in ("ab-1_seg0001", "ab-1_seg2_filtered", "cd_seg0003", "zz_seg0001"):
        touch(f"u1/recordings/recording_{name}.mp4")
    touch("u1/keylogs/input_ab-1_seg0001.msgpack")
    touch("u1/keylogs/input_ab-1_seg0002_filtered.msgpack")
    touch("u1/keylogs/input_cd_seg3.msgpack")
    touch("u2/keylogs/input_zz_seg0001.msgpack")
    found = files.find_recordings(spark, str(tmp_path)).collect()
    assert sorted((r.session_id, r.seg, r.suffix) for r in found) == [("ab-1", 1, ""), ("ab-1", 2, "_filtered")]


def test_clip_index(spark, tmp_path):
    folder = tmp_path / "train"
    folder.mkdir()
    clip = {"clip_id": "c", "clip_dir": "train/c", "num_frames": 2, "fps": 5, "actions": [{"frame": "F00", "type": "KeyPress", "details": "A"}]}
    (folder / "train.jsonl").write_text(json.dumps(clip) + "\n\n" + json.dumps({**clip, "actions": []}) + "\n")
    rows = files.read_clip_index(spark, str(tmp_path)).collect()
    assert [(r.split, len(r.actions)) for r in rows] == [("train", 1), ("train", 0)]
    assert files.read_clip_index(spark, str(tmp_path / "none")).count() == 0
    files.write_clip_index(files.read_clip_index(spark, str(tmp_path)), str(tmp_path / "out"))
    assert files.read_clip_index(spark, str(tmp_path / "out")).count() == 2


def test_eval_clips(spark, tmp_path):
    folder = tmp_path / "deep" / "er"
    folder.mkdir(parents=True)
    for name in ("clip_1", "clip_2"):
        (folder / f"{name}.json").write_text(json.dumps({"start_s": 1.5, "end_s": 2.5, "tag": "t", "actions": LOG[:2]}, indent=1))
    (folder / "clip_1.mp4").write_bytes(b"x")
    rows = files.read_eval_clips(spark, str(tmp_path)).collect()
    assert [(r.clip_name, r.start_s, r.tag, len(r.actions)) for r in rows] == [("clip_1", 1.5, "t", 2)]


def test_results(spark, tmp_path):
    clip = {"clip_index": 0, "clip_name": "c", "tag": "t", "start_s": 0.5, "ground_truth": LOG[:4], "raw_response": "[]",
            "predictions": [{"frame": "F01", "type": "KeyPress", "details": "a"}, {"frame": "F02", "type": "KeyPress", "detail": "b"}]}
    document = {"model_id": "m", "fps": 2, "tolerance": 2, "coalesce": True, "interleave_labels": False, "clips": [clip, {**clip, "clip_index": 1}]}
    path = tmp_path / "results.json"
    path.write_text(json.dumps(document, indent=2))
    rows = files.read_results(spark, str(path))
    assert rows.count() == 2
    truth = keylog.parse_entries(files.truth_entries(rows, ["clip_index"]))
    assert truth.count() == 8 and {"start_s", "fps"} <= set(truth.columns)

    from inputtrace.operators.predictions import filter_predictions

    said = filter_predictions(files.predicted_actions(rows, ["clip_index"])).where("clip_index = 0").collect()
    assert sorted((r.frame, r.detail["detail"] if isinstance(r.detail, dict) else r.detail) for r in said) == [(1, "A"), (2, "B")]


def png(width, height, pixel) -> bytes:
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_black_frames(spark, tmp_path):
    bright = lambda rows: lambda x, y: (200, 200, 200) if y < rows else (0, 0, 14)
    pictures = {0: bright(100), 1: bright(0), 2: bright(10), 3: bright(4), 4: bright(5), 100: lambda x, y: (15, 0, 0)}
    for i, pixel in pictures.items():
        (tmp_path / f"F{i:02d}.png").write_bytes(png(100, 100, pixel))
    (tmp_path / "F05.png").write_bytes(b"not an image")
    frames = files.read_frames(spark, str(tmp_path)).select(F.lit("r").alias("recording_id"), "frame_idx", "data", "n_channels")
    shares = FR.black_fractions(frames)
    assert {r.frame_idx: round(r.black_fraction, 2) for r in shares.collect()} == {0: 0.0, 1: 1.0, 2: 0.9, 3: 0.96, 4: 0.95, 100: 0.0}
    kept = FR.drop_black_frames(shares)
    events = spark.createDataFrame([("r", f, "KeyPress", d) for f, d in ((0, "A"), (1, "B"), (2, "C"), (100, "E"))], "recording_id string, frame_idx int, type string, details string")
    moved = FR.reindex_events(events, kept).collect()
    assert sorted((r.frame_idx, r.details) for r in moved) == [(0, "A"), (1, "C"), (3, "E")]
    assert FR.drop_black_frames(shares, 1.0).count() == 6
    assert FR.frame_counts(kept).first().num_frames == 4


def test_api_messages(spark, tmp_path):
    (tmp_path / "F00.png").write_bytes(b"x" * 300)
    content = files.read_frame_bytes(spark, str(tmp_path)).select(text.build_api_messages(F.array("content"), F.lit("p")).alias("m")).first().m[0].content
    assert content[0].image_url.url.startswith("data:image/png;base64,eHh4") and "\n" not in content[0].image_url.url
    assert content[1].text == "p"


def test_scroll_payloads(spark):
    texts = ['[1000000,["MouseScroll",[null,-1,0,0]]]', '[2000000,["MouseScroll",{"direction":"down"}]]', '[3000000,["MouseScroll",[2,0]]]']
    log = keylog.parse_entries(spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "recording_id string, ord bigint, entry string"))
    truth = gt_actions(log.withColumn("start_s", F.lit(0.0)), 2)
    assert sorted((r.frame, r.detail) for r in truth.collect()) == [(2, "down"), (4, "down")]
    moved = scroll_per_frame(in_frames(log, 2, 10))
    assert [(r.frame, r.delta) for r in moved.collect()] == [(6, 2.0)]


def test_extension_values_and_broken_files(spark, tmp_path):
    entry = b"\x92" + pack(500_000) + b"\x92" + pack("KeyPress") + b"\x93" + pack(1) + pack("KeyA") + b"\xd6\x05abcd"
    (tmp_path / "a.msgpack").write_bytes(b"\x91" + entry)
    (tmp_path / "b.msgpack").write_bytes(b"\x91" + entry[:-2])
    (tmp_path / "c.msgpack").write_bytes(pack({"no": 1}))
    rows = keylog.read_binary_keylogs(spark, str(tmp_path)).collect()
    assert [(r.ts_us, r.raw_key) for r in rows] == [(500_000, "KeyA")]
    good, bad = keylog.quarantine_keylogs(spark, str(tmp_path), str(tmp_path / "kept"))
    assert [(r.ts_us, r.raw_key) for r in good.collect()] == [(500_000, "KeyA")]
    broken = {r.recording_id[-9:]: r.reason for r in bad.collect()}
    assert broken == {"b.msgpack": "value cut off", "c.msgpack": "not a list of entries"}


def test_quarantine_opens_each_log_once(spark, tmp_path):
    (tmp_path / "a.msgpack").write_bytes(pack(LOG))
    (tmp_path / "b.msgpack").write_bytes(pack(LOG)[:-3])
    marks = tmp_path / "opened"
    marks.mkdir()

    def decode(file):
        (marks / f"{len(list(marks.iterdir()))}-{file.name[-9:]}").write_text("")
        yield from keylog.stream_entries(file)

    good, bad = keylog.quarantine_keylogs(spark, str(tmp_path), str(tmp_path / "kept"), decode)
    _check(good.collect())
    reasons = sorted((r.recording_id[-9:], r.ord if r.ord is not None else -1, r.reason) for r in bad.collect())
    of_entries = [
        (5, "no time"), (6, "no time"), (7, "no event type"), (8, "no event type"), (9, "no event"), (10, "not a list"), (11, "not a list"),
    ]
    assert [r[1:] for r in reasons if r[0] == "a.msgpack"] == of_entries
    assert ("b.msgpack", -1, "value cut off") in reasons
    assert len(list(marks.iterdir())) == 2


def test_log_longer_than_the_buffer():
    import io

    items = [[i, ["KeyPress", [1, "KeyA" * (i % 50)]]] for i in range(5000)] + ["x" * 3000]
    raw = b"\xdd" + struct.pack(">I", len(items)) + b"".join(pack(i) for i in items)

    class Reads(io.BytesIO):
        largest = 0

        def read(self, size=-1):
            assert size > 0
            Reads.largest = max(Reads.largest, size)
            return super().read(size)

    for size in (1, 7, 64, 1 << 20):
        Reads.largest = 0
        assert list(keylog.stream_entries(Reads(raw), size)) == items
        assert Reads.largest <= max(4096, size)
    for cut in (0, 1, 3, 5, 6, len(raw) - 1):
        with pytest.raises(ValueError):
            list(keylog.stream_entries(io.BytesIO(raw[:cut]), 16))
    with pytest.raises(ValueError, match="bytes after"):
        list(keylog.stream_entries(io.BytesIO(raw + b"\x01"), 16))
    assert list(keylog.stream_entries(io.BytesIO(b"\x90"))) == []


def test_binary_rows_are_those_of_json(spark, tmp_path):
    import random

    rnd = random.Random(5)
    values = [None, True, 0, 3, -1, 1.75, -2.5, "x", "12", "UNKNOWN", "KeyA", "Left", "UNCAPTURED", [], ["UNCAPTURED"], ["Left"], [1, "KeyB"], {"direction": "up"}, [0, 1.5], ["2", "z"]]
    kinds = ["KeyPress", "KeyRelease", "MousePress", "MouseScroll", "ContextChanged", "MouseMove"]
    entries = [
        rnd.choice([[rnd.choice([rnd.randrange(10**7), 1.9, "77", None]), [rnd.choice(kinds), rnd.choice(values)]], [1, [rnd.choice(kinds)]], rnd.choice(values), [5, rnd.choice([[], "a", None])]])
        for _ in range(400)
    ]
    (tmp_path / "log.json").write_text(json.dumps(entries))
    (tmp_path / "log.msgpack").write_bytes(pack(entries))
    columns = [c.split()[0] for c in keylog.PARSED_LOG.split(", ")][1:]
    read = lambda df: sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert read(keylog.read_binary_keylogs(spark, str(tmp_path))) == read(keylog.read_json_keylogs(spark, str(tmp_path / "log.json")))


def test_broken_frames_are_kept_apart(spark, tmp_path):
    for rec in ("a", "b"):
        (tmp_path / "in" / f"recording_id={rec}").mkdir(parents=True)
        (tmp_path / "in" / f"recording_id={rec}" / "F03.png").write_bytes(png(4, 2, lambda x, y: (x, y, 7)))
    (tmp_path / "in" / "recording_id=a" / "F04.png").write_bytes(png(4, 2, lambda x, y: (x, y, 7))[:40])
    good, bad = keylog.kept_apart(files.tag_frames(spark, str(tmp_path / "in")), str(tmp_path / "kept"))
    assert sorted((r.recording_id, r.frame_idx, r.height, r.width, sum(r.data)) for r in good.collect()) == [("a", 3, 2, 4, 72), ("b", 3, 2, 4, 72)]
    assert [(r.recording_id, r.frame_idx, r.reason) for r in bad.collect()] == [("a", 4, "not an image")]
    plan = files.read_frames(spark, str(tmp_path / "in")).where("recording_id = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(recording_id" in plan


def test_corrupt_entries(spark):
    texts = ['[1,["KeyPress"]]', "[1]", '{"ts":1}', '["soon",["KeyPress"]]', "[1,[]]", "[1,", '"text"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord bigint, entry string")
    got = {r.ord: r.reason for r in keylog.corrupt_entries(df).collect()}
    assert got == {1: "no event", 2: "not a list", 3: "no time", 4: "no event type", 5: "not JSON", 6: "not a list"}


def test_two_documents_with_one_clip_number(spark, tmp_path):
    clip = {"clip_index": 0, "clip_name": "c", "tag": "t", "start_s": 0.0, "predictions": [{"frame": "F02", "type": "KeyPress", "details": "A"}],
            "ground_truth": [[1_000_000, ["KeyPress", [1, "KeyA"]]], [1_400_000, ["KeyRelease", [1, "KeyA"]]]]}
    for name, predictions in (("a", clip["predictions"]), ("b", [])):
        text = json.dumps({"model_id": "m", "fps": 2, "clips": [{**clip, "clip_name": name, "predictions": predictions}]})
        (tmp_path / f"{name}.json").write_text(text)
    rows = score_results(files.read_results(spark, str(tmp_path))).collect()
    clips = {r.clip_name: (r.tp, r.fn, r.tag) for r in rows if r.level == "clip"}
    assert clips == {"a": (1, 0, "t"), "b": (0, 1, "t")}
    assert [(r.tp, r.fn) for r in rows if r.level == "overall"] == [(1, 1)]


def test_frames_are_written_by_many_tasks(spark, tmp_path):
    from inputtrace.checks import inputs

    table = inputs.table(spark, "/root/testdata/sf0.001", "embeddings").limit(200).coalesce(1)
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    group = "frames"
    spark.sparkContext.setJobGroup(group, group)
    try:
        inputs.write_frames(spark, str(tmp_path), str(tmp_path / "frames"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    tasks = [tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)]
    assert max(tasks) >= 2 * spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "frames").rglob("*.png"))) == 200

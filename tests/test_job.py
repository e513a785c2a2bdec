"""Folders to an index with metadata, and evaluation clips to scores."""

import json

import pytest

import simulate
from inputtrace.plans.job import prepare_recordings, run_metadata, score_eval_clips
from inputtrace.plans.training import training_clips
from inputtrace.sources import files
from inputtrace.sources.schemas import LOG
from test_sources import pack, png


def press(ts, name, kind="KeyPress"):
    return [ts, [kind, [1, name]]]


def _entries(seed):
    """A log as it is stored, and as typed rows."""
    rows = simulate.random_log(seed, recordings=1, rows=8)
    stored = []
    for _, _, ts, etype, key, button, dx, dy, uncaptured in rows:
        payload = {"Key": [1, key], "Mous": [button, 0, 0]}.get("Key" if etype.startswith("Key") else "Mous")
        if etype == "MouseScroll":
            payload = [dx, dy, 0, 0]
        elif etype == "ContextChanged":
            payload = ["UNCAPTURED" if uncaptured else "app"]
        stored.append([ts, [etype, payload]])
    return stored, rows


def _folders(tmp_path):
    """Five recordings of 24 frames: a broken log, one without frames, one without a log, and two good ones."""
    bright, black = png(10, 10, lambda x, y: (200, 200, 200)), png(10, 10, lambda x, y: (0, 0, 0))
    typed = []
    for user, name, seed in (("u1", "ab-1_seg0001", 31), ("u1", "ab-1_seg0002", 32), ("u2", "cd_seg0001", 33), ("u2", "cd_seg0002", 34), ("u2", "ef_seg0001", None)):
        video = tmp_path / "in" / user / "recordings" / f"recording_{name}.mp4"
        video.parent.mkdir(parents=True, exist_ok=True)
        video.write_bytes(b"x")
        logs = tmp_path / "in" / user / "keylogs"
        logs.mkdir(exist_ok=True)
        if seed:
            stored, rows = _entries(seed)
            (logs / f"input_{name}.msgpack").write_bytes(pack(stored)[: -4 if seed == 33 else None])
            if seed not in (33, 34):
                typed += [(f"recording_{name}", *row[1:]) for row in rows]
        if seed != 34:
            folder = tmp_path / "frames" / f"recording_id=recording_{name}"
            folder.mkdir(parents=True)
            for f in range(24):
                (folder / f"F{f:02d}.png").write_bytes(black if f % 7 == 3 else bright)
    return typed


def test_folders_to_index(spark, tmp_path):
    typed = _folders(tmp_path)
    settings = dict(fps=10, clip_length=10, clip_stride=5, keep_empty_ratio=1.0, train_ratio=0.5)
    out = str(tmp_path / "out")
    row = prepare_recordings(
        spark, str(tmp_path / "in"), str(tmp_path / "frames"), out, resolution="10x10", label_frames=False, **settings
    ).first()

    # The job in parts: typed rows and the share of dark pixels of each frame.
    shares = [(f"recording_ab-1_seg000{i}", f, 1.0 if f % 7 == 3 else 0.0) for i in (1, 2) for f in range(24)]
    wanted = training_clips(
        spark.createDataFrame(typed, LOG), spark.createDataFrame(shares, "recording_id string, frame_idx int, black_fraction double"), **settings
    ).collect()
    index = files.read_clip_index(spark, out).collect()
    assert len(wanted) == 6 and sum(len(c.actions) for c in wanted) > 0
    assert sorted((c.clip_id, c.num_frames, c.fps, c.actions) for c in index) == sorted((c.clip_id, c.num_frames, c.fps, c.actions) for c in wanted)
    assert all(c.clip_dir == f"{c.split}/{c.clip_id}" for c in index)

    assert (row.total_clips, row.num_failed_recordings, row.train_recordings, row.val_recordings) == (6, 2, 2, 2)
    assert (row.fps, row.clip_length, row.resolution, row.label_frames, row.top_bar_fraction) == (10, 10, "10x10", False, None)
    assert row.timing.total_s > 0 and row.timing.median_per_recording_s is None
    stored = [line for part in (tmp_path / "out" / "metadata").glob("*.json") for line in part.read_text().splitlines()]
    assert len(stored) == 1 and json.loads(stored[0])["input_dir"] == str(tmp_path / "in")

    first = prepare_recordings(spark, str(tmp_path / "in"), str(tmp_path / "frames"), str(tmp_path / "one"), max_recordings=1, **settings).first()
    assert (first.total_clips, first.num_failed_recordings, first.train_recordings + first.val_recordings) == (3, 0, 1)


def test_metadata_of_nothing(spark):
    none = spark.createDataFrame([], "recording_id string, split string")
    row = run_metadata(none, {"fps": 5}, 0, 0, seconds=1.0).first()
    assert (row.total_clips, row.num_failed_recordings, row.train_recordings, row.fps, row.timing.mean_per_recording_s) == (0, 0, 0, 5, None)
    with pytest.raises(ValueError):
        run_metadata(none, {"speed": 1}, 0, 0)


def test_eval_clips_to_scores(spark, tmp_path):
    def clip(name, start, actions):
        (tmp_path / f"{name}.json").write_text(json.dumps({"start_s": start, "end_s": start + 5, "tag": "t", "actions": actions}))
        (tmp_path / f"{name}.mp4").write_bytes(b"x")

    scroll = ["MouseScroll", [0, -1, 0, 0]]
    clip("clip_1", 1.0, [press(1_500_000, "KeyA"), press(1_600_000, "KeyA", "KeyRelease"), [2_000_000, scroll], [2_400_000, scroll]])
    clip("clip_2", 0.0, [])
    clip("clip_3", 0.0, [press(0, "KeyB")])
    clips = files.read_eval_clips(spark, str(tmp_path))
    said = [{"frame": "F01", "type": "KeyPress", "details": "a"}, {"frame": "F02", "type": "MouseScroll", "details": "Down"}, {"frame": "F09", "type": "MouseClick", "details": "Left"}]
    texts = {"clip_1": f"<think>so</think>```json\n{json.dumps(said)}\n```", "clip_2": "no list"}
    paths = {r.clip_name: r.mp4_path for r in clips.collect()}
    answers = spark.createDataFrame([(paths[n], t) for n, t in texts.items()], "mp4_path string, response string")
    for merged, missed in ((False, 1), (True, 0)):
        rows = score_eval_clips(clips, answers, 2, coalesce=merged).collect()
        found = {(r.level, r.clip_name, r.type): (r.tp, r.fp, r.fn) for r in rows}
        assert found["overall", None, None] == (2, 1, missed)
        assert found["clip", "clip_1", None] == (2, 1, missed) and found["clip", "clip_2", None] == (0, 0, 0)
        assert ("clip", "clip_3", None) not in found
        assert {(r.mp4_path, r.tag) for r in rows if r.level == "clip"} == {(paths["clip_1"], "t"), (paths["clip_2"], "t")}

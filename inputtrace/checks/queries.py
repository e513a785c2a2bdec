"""The registered queries: every operator over the given tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import frames as fn
from ..functions import metrics, names, text
from ..operators import clips as C
from ..operators import frames as FR
from ..operators import gestures, matching, reports, sampling, scoring, spans, tokens
from ..operators.predictions import filter_predictions
from ..operators.scan import split_hot
from ..plans import examples
from ..plans.job import write_training_index
from ..plans.keylog import framed_spans, gt_actions, merging_rows, parse_keylog
from ..session import scratch_path, tune
from ..sources import files, keylog
from . import inputs as I
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

REC = ["recording_id"]
CLIP = C.CLIP


def query(name: str, sql: str | None = None):
    """Register a query, and the body of its SQL counterpart where there is one."""

    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = O.sql(sql)
        return build

    return register


# --- sources and sinks ---------------------------------------------------------------------

_SESSION = "substr(md5(cast(user_id as varchar)), 1, 8) || '-' || substr(md5(cast(user_id as varchar)), 9, 4)"


def _paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A listing of videos and logs: one segment per event, some names wrong, some logs absent."""
    rows = I.events(spark, sf_dir)
    k = F.col("k")
    session = F.format_string("%08x-%04x", "user_id", "k")
    folder = F.concat(F.lit("/data/u"), (F.col("user_id") % 7).cast("string"))
    suffix = F.when(k % 5 == 0, "_filtered").otherwise("")
    seg = F.format_string("%04d", "event_id")
    video = F.concat(
        folder, F.lit("/recordings/"), F.when(k % 17 == 0, "x").otherwise(""), F.lit("recording_"),
        session, F.lit("_seg"), F.when(k % 11 == 0, "0").otherwise(""), seg, suffix, F.lit(".mp4"),
    )
    log = F.concat(
        folder, F.lit("/keylogs/input_"), session, F.lit("_seg"),
        F.when(k % 13 == 0, F.col("event_id").cast("string")).otherwise(seg), suffix, F.lit(".msgpack"),
    )
    return rows.select(video.alias("path")), rows.where("event_id % 3 <> 0").select(log.alias("path"))


_PAIRS = """
select session_id, cast(event_id as int) as seg, suffix,
 folder || '/recordings/recording_' || session_id || '_seg' || case when k % 11 = 0 then '0' else '' end || printf('%04d', event_id) || suffix || '.mp4' as video_path,
 folder || '/keylogs/input_' || session_id || '_seg' || printf('%04d', event_id) || suffix || '.msgpack' as keylog_path
from (select *, printf('%08x-%04x', user_id, k) as session_id, '/data/u' || (user_id % 7) as folder,
       case when k % 5 = 0 then '_filtered' else '' end as suffix
      from ev where event_id % 3 <> 0 and k % 17 <> 0 and (k % 13 <> 0 or event_id > 999))"""


@query("src_pair_recordings", _PAIRS)
def _(spark, sf_dir):
    return files.pair_recordings(*_paths(spark, sf_dir))


@query("src_limit_recordings", f"select video_path, keylog_path from ({_PAIRS}) order by video_path limit 20")
def _(spark, sf_dir):
    pairs = files.pair_recordings(*_paths(spark, sf_dir))
    return sampling.first_recordings(pairs, "video_path", 20).select("video_path", "keylog_path")


@query(
    "src_keylog",
    """
select recording_id, ord, ts_us, etype,
 case when etype in ('KeyPress', 'KeyRelease') then raw_key end as raw_key,
 case when etype in ('MousePress', 'MouseRelease') then button end as button,
 case when etype = 'MouseScroll' then dx else 0 end as dx, case when etype = 'MouseScroll' then dy else 0 end as dy,
 cast(null as varchar) as direction, etype = 'ContextChanged' as uncaptured
from keylog where ord % 97 not in (1, 2, 3, 4)""",
)
def _(spark, sf_dir):
    return keylog.parse_entries(_entries(spark, sf_dir))


def _entries(spark, sf_dir) -> DataFrame:
    """Log rows as JSON entries; some times have a fraction, some entries are broken."""
    log = I.keylog(spark, sf_dir)
    etype, ord_ = F.col("etype"), F.col("ord")
    payload = (
        F.when(etype.isin("KeyPress", "KeyRelease"), F.format_string('[1,"%s"]', "raw_key"))
        .when(etype.isin("MousePress", "MouseRelease"), F.format_string('["%s",0.0,0.0]', "button"))
        .when(etype == "MouseScroll", F.format_string("[%s,%s,0,0]", F.col("dx").cast("string"), F.col("dy").cast("string")))
        .when(etype == "ContextChanged", F.lit('["UNCAPTURED"]'))
        .otherwise(F.lit("[]"))
    )
    time = F.concat(F.col("ts_us").cast("string"), F.when(ord_ % 5 == 0, ".75").otherwise(""))
    turn = ord_ % 97
    entry = (
        F.when(turn == 1, F.concat(F.lit("["), time, F.lit("]")))
        .when(turn == 2, F.concat(F.lit('["soon",["'), etype, F.lit('"]]')))
        .when(turn == 3, F.concat(F.lit("["), time, F.lit(",[]]")))
        .when(turn == 4, F.concat(F.lit('{"ts":'), time, F.lit("}")))
        .otherwise(F.concat(F.lit("["), time, F.lit(',["'), etype, F.lit('",'), payload, F.lit("]]")))
    )
    return log.select("recording_id", "ord", entry.alias("entry"))


@query(
    "quarantine_corrupt",
    """
select recording_id, ord, case ord % 97 when 1 then 'no event' when 2 then 'no time' when 3 then 'no event type' else 'not a list' end as reason
from keylog where ord % 97 in (1, 2, 3, 4)
union all select vec_id // 50, vec_id % 50, 'not an image' from embeddings where vec_id % 97 = 0""",
)
def _(spark, sf_dir):
    """Bad log entries and bad frames."""
    entries = keylog.corrupt_entries(_entries(spark, sf_dir)).select("recording_id", "ord", "reason")
    frames = _tagged_frames(spark, sf_dir).where("reason is not null")
    return entries.union(frames.select(F.col("recording_id").cast("bigint"), F.col("frame_idx").cast("bigint"), "reason"))


def _indexed(spark, sf_dir, clips: DataFrame | None = None) -> DataFrame:
    """Clip index rows of the 25-frame clips, split by recording; further columns of ``clips`` stay."""
    clips = I.clips(spark, sf_dir) if clips is None else clips
    more = [c for c in clips.columns if c not in (*CLIP, "num_frames")]
    actions = I.clip_actions(spark, sf_dir)
    split = sampling.split_recordings(I.recordings(spark, sf_dir), "recording_id")
    rows = C.nest_actions(clips, actions).join(split, "recording_id")
    clip_id = F.format_string("rec_%d_c%03d", "recording_id", "chunk")
    return rows.select(
        clip_id.alias("clip_id"), F.concat_ws("/", "split", clip_id).alias("clip_dir"), "num_frames",
        F.lit(I.FPS).alias("fps"), "actions", "split", *more,
    )


_INDEX = """
select printf('rec_%d_c%03d', c.recording_id, c.chunk) as clip_id,
 s.split || '/' || printf('rec_%d_c%03d', c.recording_id, c.chunk) as clip_dir, c.num_frames, 5 as fps, s.split,
 a.n_actions, a.actions
from clips c join split s on s.recording_id = c.recording_id
join (select recording_id, chunk, count(*) as n_actions,
       string_agg(frame || type || details, '|' order by cast(substr(frame, 2) as int), pos) as actions
      from clip_actions group by 1, 2) a on a.recording_id = c.recording_id and a.chunk = c.chunk"""


def _flat(clips: DataFrame) -> DataFrame:
    """Clip rows with their actions as one text."""
    listed = F.array_join(F.transform("actions", lambda a: F.concat(a["frame"], a["type"], a["details"])), "|")
    return clips.select(
        "clip_id", "clip_dir", "num_frames", "fps", "split",
        F.size("actions").cast("bigint").alias("n_actions"), listed.alias("actions"),
    )


@query("sink_clip_index", _INDEX)
def _(spark, sf_dir):
    path = scratch_path(spark, "clips")
    files.write_clip_index(_indexed(spark, sf_dir), path)
    return _flat(files.read_clip_index(spark, path))


@query("src_clip_index", f"select split, count(*) as clips, sum(n_actions)::bigint as actions from ({_INDEX}) group by 1")
def _(spark, sf_dir):
    path = scratch_path(spark, "clips")
    files.write_clip_index(_indexed(spark, sf_dir), path)
    found = files.read_clip_index(spark, path, ("train", "val", "test"))
    return found.groupBy("split").agg(
        F.count(F.lit(1)).alias("clips"), F.sum(F.size("actions")).alias("actions")
    )


@query(
    "src_eval_clips",
    """
select 'clip_' || event_id as clip_name, '/eval/' || user_id || '/clip_' || event_id || '.mp4' as mp4_path,
 cast(k as double) as start_s, cast(k + 5 as double) as end_s, 'tag' || (k % 3) as tag
from ev where event_id % 4 <> 0""",
)
def _(spark, sf_dir):
    rows = I.events(spark, sf_dir)
    stem = F.concat(F.lit("/eval/"), F.col("user_id").cast("string"), F.lit("/clip_"), F.col("event_id").cast("string"))
    described = rows.select(
        F.concat(stem, F.lit(".json")).alias("path"),
        F.col("k").cast("double").alias("start_s"),
        (F.col("k") + 5).cast("double").alias("end_s"),
        F.concat(F.lit("tag"), (F.col("k") % 3).cast("string")).alias("tag"),
    )
    videos = rows.where("event_id % 4 <> 0").select(F.concat(stem, F.lit(".mp4")).alias("path"))
    return files.with_video(described, videos).drop("path")


@query(
    "src_results",
    """
select cast(k.ord // 16 as int) as clip_index, count(*) as n_truth, sum(k.ts_us)::bigint as sum_ts,
 coalesce(max(p.n), 0)::bigint as n_preds, coalesce(max(p.frames), '') as frames
from keylog k left join (select pos // 16 as block, count(*) as n, string_agg(frame, '|' order by pos) as frames from preds group by 1) p
 on p.block = k.ord // 16
group by k.ord // 16""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "results")
    _write_results(spark, sf_dir, path)
    rows = files.read_results(spark, path, one_per_line=True)
    truth = keylog.parse_entries(files.truth_entries(rows, ["clip_index"]))
    asked = truth.groupBy("clip_index").agg(F.count(F.lit(1)).alias("n_truth"), F.sum("ts_us").alias("sum_ts"))
    said = rows.select(
        "clip_index", F.size("predictions").cast("bigint").alias("n_preds"),
        F.array_join(F.transform("predictions", lambda p: p["frame"]), "|").alias("frames"),
    )
    return asked.join(said, "clip_index")


def _write_results(spark, sf_dir, path: str) -> None:
    """A result document per 16 log rows, so that no document grows with the table."""
    block = F.floor(F.col("ord") / 16)
    entry = F.format_string('[%d,["%s",[1,"%s"]]]', "ts_us", "etype", "raw_key")
    truth = I.keylog(spark, sf_dir).groupBy(block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))).alias("truth")
    )
    said = I.preds(spark, sf_dir).groupBy(F.floor(F.col("pos") / 16).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.to_json(F.struct("frame", "type", "details")).alias("e")))).alias("said")
    )
    join = lambda c: F.array_join(F.transform(c, lambda x: x["e"]), ",")
    clip = F.concat(
        F.lit('{"model_id":"m","fps":5,"tolerance":2,"coalesce":true,"interleave_labels":false,"clips":[{"clip_index":'),
        F.col("block").cast("string"),
        F.lit(',"clip_name":"c","tag":"t","start_s":0.0,"ground_truth":['), join("truth"),
        F.lit('],"predictions":['), F.coalesce(join("said"), F.lit("")), F.lit("]}]}"),
    )
    truth.join(said, "block", "left").select(clip.alias("value")).write.text(path)


@F.pandas_udf(T.LongType())
def _pixel_sum(data: pd.Series) -> pd.Series:
    return data.map(lambda raw: int(np.frombuffer(raw, np.uint8).sum(dtype=np.int64)))


def _tagged_frames(spark, sf_dir) -> DataFrame:
    root = scratch_path(spark, "frames")
    I.write_frames(spark, sf_dir, root)
    return files.tag_frames(spark, root)


@query(
    "src_frames",
    """
select vec_id // 50 as recording_id, cast(vec_id % 50 as int) as frame_idx, 8 as height, 8 as width, 1 as n_channels,
 cast(list_sum(list_transform(embedding, lambda v: least(255, floor(abs(v::double) * 150)))) as bigint) as pixel_sum
from embeddings where vec_id % 97 <> 0""",
)
def _(spark, sf_dir):
    """The vectors as image files, opened and summed up."""
    found = _tagged_frames(spark, sf_dir).where("reason is null")
    columns = [F.col("recording_id").cast("bigint").alias("recording_id"), "frame_idx", "height", "width", "n_channels"]
    return found.select(*columns, _pixel_sum("data").alias("pixel_sum"))


@query(
    "src_first_fps",
    "select cast(coalesce(arg_min(k, event_id), 5) as int) as fps, count(distinct k) as distinct_fps from ev",
)
def _(spark, sf_dir):
    return files.first_fps(I.events(spark, sf_dir).withColumnRenamed("k", "fps"), "event_id")


@query("sink_summary", "select level, recording_id, type, gt_count, pred_count, tp, fp, fn, precision, recall, f1 from rollup")
def _(spark, sf_dir):
    path = scratch_path(spark, "summary")
    scores = _scores(spark, sf_dir)
    files.write_summary(scores, path)
    return spark.read.schema(scores.schema).json(path)


@query(
    "sink_metadata",
    """
with made as (select c.recording_id, s.split from clips c join split s on s.recording_id = c.recording_id),
 taken as (select user_id, (max(event_id) - min(event_id)) / 1000.0::double as s from events group by 1)
select 'events' as input_dir, 5 as fps, '8x8' as resolution, 0.05::double as top_bar_fraction, 0.45::double as black_threshold,
 25 as clip_length, 25 as clip_stride, 'all' as action_types, true as label_frames,
 (select count(*) from made) as total_clips,
 (select count(*) from recordings) - (select count(distinct recording_id) from made) as num_failed_recordings,
 (select count(*) from split where split = 'train') as train_recordings,
 (select count(*) from split where split = 'val') as val_recordings, 42 as seed,
 round_even(sum(s), 1) as total_s, round_even(sum(s) / count(*), 2) as mean_per_recording_s,
 round_even(list_sort(list(s))[count(*) // 2 + 1], 2) as median_per_recording_s, round_even(max(s), 2) as max_per_recording_s
from taken""",
)
def _(spark, sf_dir):
    split = sampling.split_recordings(I.recordings(spark, sf_dir), "recording_id")
    first = F.row_number().over(Window.partitionBy("recording_id").orderBy("chunk")) == 1
    clips = _indexed(spark, sf_dir, I.clips(spark, sf_dir).withColumn("is_first", first))
    settings = dict(
        input_dir="events", fps=I.FPS, resolution="8x8", top_bar_fraction=0.05, black_threshold=BLACK,
        clip_length=I.CLIP_FRAMES, clip_stride=I.CLIP_FRAMES, action_types="all", label_frames=True, seed=42,
    )
    row = write_training_index(clips, split, scratch_path(spark, "index"), settings, _timed(spark, sf_dir, "seconds"))
    return row.select("*", "timing.*").drop("timing")


# --- projections and filters ---------------------------------------------------------------

_RAW = "[" + ", ".join(f"'{n}'" for n in I.RAW_NAMES) + f"][k % {len(I.RAW_NAMES)} + 1]"


def _raw_names(spark, sf_dir) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(n) for n in I.RAW_NAMES]), F.col("k") % len(I.RAW_NAMES) + 1)
    return I.events(spark, sf_dir).select("event_id", "user_id", "k", raw.alias("raw"))


@query("normalize_key", f"select event_id, raw, {O._normal('raw')} as key from (select event_id, {_RAW} as raw from ev)")
def _(spark, sf_dir):
    return _raw_names(spark, sf_dir).select("event_id", "raw", names.normalize_key(F.col("raw")).alias("key"))


@query(
    "format_combo",
    f"""
select event_id, case when key in ('Shift', 'Ctrl', 'Alt', 'AltGr', 'Cmd') then key else
 case when event_id % 2 = 0 then 'Cmd+' else '' end || case when event_id % 3 = 0 then 'Ctrl+' else '' end ||
 case when event_id % 5 = 0 then 'Alt+' else '' end || case when event_id % 7 = 0 then 'Shift+' else '' end || key end as combo
from (select event_id, {O._normal('raw')} as key from (select event_id, {_RAW} as raw from ev))""",
)
def _(spark, sf_dir):
    held = {m: F.col("event_id") % p == 0 for m, p in {"Cmd": 2, "Ctrl": 3, "Alt": 5, "Shift": 7}.items()}
    return _raw_names(spark, sf_dir).select(
        "event_id", names.format_combo(names.normalize_key(F.col("raw")), held).alias("combo")
    )


@query(
    "payload_key",
    f"select event_id, case when k % 4 = 0 or raw = 'UNKNOWN' then null else raw end as key from (select event_id, k, {_RAW} as raw from ev)",
)
def _(spark, sf_dir):
    whole = F.array(F.col("k").cast("string"), "raw")
    payload = F.when(F.col("k") % 8 == 0, F.slice(whole, 1, 1)).when(F.col("k") % 4 != 0, whole)
    return _raw_names(spark, sf_dir).select("event_id", names.payload_key(payload).alias("key"))


_BUTTON = "['Left', 'Right', 'Middle', 'Back'][k % 4 + 1]"


@query("payload_button", f"select event_id, case when {_BUTTON} <> 'Back' then {_BUTTON} end as button from ev")
def _(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(b) for b in ("Left", "Right", "Middle", "Back")]), F.col("k") % 4 + 1)
    return I.events(spark, sf_dir).select("event_id", names.payload_button(F.array(name, F.lit("0"))).alias("button"))


@query(
    "scroll_delta",
    "select recording_id, ord, case when dy <> 0 then dy else dx end as delta from keylog where etype = 'MouseScroll' and (dx <> 0 or dy <> 0)",
)
def _(spark, sf_dir):
    delta = names.scroll_delta(F.col("dx"), F.col("dy"))
    log = I.keylog(spark, sf_dir).where("etype = 'MouseScroll'")
    return log.select("recording_id", "ord", delta.alias("delta")).where("delta is not null")


@query(
    "scroll_direction_gt",
    "select recording_id, ord, case when dy < 0 then 'down' else 'up' end as direction from keylog where etype = 'MouseScroll' and dy <> 0",
)
def _(spark, sf_dir):
    log = I.keylog(spark, sf_dir).where("etype = 'MouseScroll'")
    direction = names.scroll_direction(F.col("dy"))
    return log.select("recording_id", "ord", direction.alias("direction")).where("direction is not null")


@query("frame_floor", "select recording_id, ord, frame from framed")
def _(spark, sf_dir):
    return spans.in_frames(I.keylog(spark, sf_dir), I.FPS, I.FRAMES).select("recording_id", "ord", "frame")


@query("frame_round", "select recording_id, ord, frame from gt_framed")
def _(spark, sf_dir):
    return spans.in_rounded_frames(I.truth_log(spark, sf_dir), I.FPS).select("recording_id", "ord", "frame")


@query("frame_label", "select recording_id, ord, printf('F%02d', frame) as label from framed")
def _(spark, sf_dir):
    framed = spans.in_frames(I.keylog(spark, sf_dir), I.FPS, I.FRAMES)
    return framed.select("recording_id", "ord", fn.frame_label(F.col("frame")).alias("label"))


_LABEL = "case k % 6 when 0 then printf('F%02d', k) when 1 then ' f' || k || ' ' when 2 then 'F-' || k when 3 then 'x' || k when 4 then '' else 'F' end"


@query(
    "parse_frame_label",
    f"""
select event_id, try_cast(replace(label, 'F', '') as int) as listed, try_cast(substr(label, 2) as int) as after_first,
 coalesce(try_cast(nullif(regexp_extract(trim(label), '^[Ff]([+-]?[0-9]+)$', 1), '') as int), -1) as predicted,
 case when label = '' then 0 else try_cast(nullif(regexp_replace(label, '[^0-9]', '', 'g'), '') as int) end as digits
from (select event_id, {_LABEL} as label from ev)""",
)
def _(spark, sf_dir):
    k = F.col("k")
    number = k.cast("string")
    label = (
        F.when(k % 6 == 0, F.format_string("F%02d", k)).when(k % 6 == 1, F.concat(F.lit(" f"), number, F.lit(" ")))
        .when(k % 6 == 2, F.concat(F.lit("F-"), number)).when(k % 6 == 3, F.concat(F.lit("x"), number))
        .when(k % 6 == 4, "").otherwise("F")
    )
    labels = I.events(spark, sf_dir).select("event_id", label.alias("label"))
    c = F.col("label")
    return labels.select(
        "event_id", fn.frame_of_label(c).alias("listed"), fn.frame_after_first_char(c).alias("after_first"),
        fn.frame_of_prediction(c).alias("predicted"), fn.frame_from_digits(c).alias("digits"),
    )


@query("filter_action_types", "select recording_id, pos, type from preds where type in ('KeyPress', 'MouseClick')")
def _(spark, sf_dir):
    kept = F.col("type").isin(*names.selected_types("keyboard,click"))
    return I.preds(spark, sf_dir).where(kept).select("recording_id", "pos", "type")


@query(
    "short_clip_id",
    f"""
select event_id, 'rec_' || regexp_replace({_SESSION} || '_seg' || printf('%04d', k), '([0-9a-f]{{6}})[0-9a-f-]+', '\\1', 'g')
 || printf('_c%03d', event_id % 1200) as clip_id from ev""",
)
def _(spark, sf_dir):
    digest = F.md5(F.col("user_id").cast("string"))
    name = F.concat(
        F.lit("recording_"), F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("_seg"),
        F.format_string("%04d", "k"), F.lit(".mp4"),
    )
    clip_id = fn.short_clip_id(name, F.col("event_id") % 1200)
    return I.events(spark, sf_dir).select("event_id", clip_id.alias("clip_id"))


_SPELLED = "['SemiColon', 'Cmd+BackSlash', 'Unknown(12)', 'Shift+BackQuote', 'Cmd++', 'A'][pos % 6 + 1]"


def _spelled(actions: DataFrame) -> DataFrame:
    spellings = ["SemiColon", "Cmd+BackSlash", "Unknown(12)", "Shift+BackQuote", "Cmd++", "A"]
    name = F.element_at(F.array(*[F.lit(s) for s in spellings]), (F.col("pos") % 6 + 1).cast("int"))
    return actions.withColumn("details", F.when(F.col("type") == "KeyPress", name).otherwise(F.col("details")))


_RENAMED = "replace(replace(replace(details, 'SemiColon', 'Semicolon'), 'BackSlash', 'Backslash'), 'BackQuote', 'Backtick')"
_SPELLED_ACTIONS = f"select * replace (case when type = 'KeyPress' then {_SPELLED} else details end as details) from clip_actions"


@query(
    "normalize_training_actions",
    f"select recording_id, chunk, pos, frame, type, {_RENAMED} as details from ({_SPELLED_ACTIONS}) where not contains(details, 'Unknown(')",
)
def _(spark, sf_dir):
    return C.normalize_training_actions(_spelled(I.clip_actions(spark, sf_dir)))


@query(
    "normalize_pred_key",
    f"select recording_id, pos, details as given, {O.PREDICTED_KEY} as detail from preds where type = 'KeyPress'",
)
def _(spark, sf_dir):
    keyed = I.preds(spark, sf_dir).where("type = 'KeyPress'")
    detail = names.normalize_pred_key(F.col("details"))
    return keyed.select("recording_id", "pos", F.col("details").alias("given"), detail.alias("detail"))


@query("filter_predictions", "select recording_id, pos, frame, type, detail from scored")
def _(spark, sf_dir):
    return I.scored_preds(spark, sf_dir).select("recording_id", "pos", "frame", "type", "detail")


@query(
    "parse_response",
    """
select pos // 16 as response_id, row_number() over (partition by pos // 16 order by pos) - 1 as item, frame, type, details
from preds where (pos // 16) % 4 <> 3""",
)
def _(spark, sf_dir):
    parsed = I.responses(spark, sf_dir).select("response_id", text.parse_response(F.col("raw_response")).alias("items"))
    return parsed.select("response_id", F.posexplode("items").alias("item", "a")).select(
        "response_id", F.col("item").cast("bigint").alias("item"), "a.frame", "a.type", "a.details"
    )


_FPS = "(1 + k % 30)"
_NFRAMES = "(1 + event_id % 130)"


def _prompt_sql() -> str:
    quoted = "'" + text.PROMPT.replace("'", "''") + "'"
    return (
        f"replace(replace(replace(replace({quoted}, '{{fps}}', cast({_FPS} as varchar)), '{{ms}}', "
        f"cast(cast(round_even(1000.0::double / {_FPS}, 0) as bigint) as varchar)), '{{n}}', cast({_NFRAMES} as varchar)), "
        f"'{{last}}', printf('F%02d', {_NFRAMES} - 1))"
    )


@query("build_prompt", f"select event_id, {_prompt_sql()} as prompt from ev")
def _(spark, sf_dir):
    rows = I.events(spark, sf_dir)
    fps, n = (1 + F.col("k") % 30), (1 + F.col("event_id") % 130)
    return rows.select("event_id", text.build_prompt(fps, n).alias("prompt"))


def _message_rows(frame: DataFrame, key: str, messages) -> DataFrame:
    """One row per content item of the messages."""
    turns = frame.select(key, F.posexplode(messages).alias("turn", "m"))
    return turns.select(key, "turn", "m.role", F.posexplode("m.content").alias("item", "c")).select(
        key, "turn", "role", "item", "c.*"
    )


@query(
    "build_messages",
    """
with c as (select event_id, 1 + k % 3 as n, 1 + k % 30 as fps, '/c/' || user_id as dir from ev),
 f as (select event_id, n, dir, unnest(range(0, n)) as i from c)
select event_id, 0 as turn, 'user' as role, cast(2 * i as int) as item, 'text' as type, 'Frame ' || printf('F%02d', i) || ':' as text, null::varchar as image from f
union all select event_id, 0, 'user', cast(2 * i + 1 as int), 'image', null, dir || '/' || printf('F%02d', i) || '.jpg' from f
union all select event_id, 0, 'user', cast(2 * n as int), 'text', 'P' || n, null from c
union all select event_id, 1, 'assistant', 0, 'text', '[]', null from c""",
)
def _(spark, sf_dir):
    rows = I.events(spark, sf_dir)
    n = 1 + F.col("k") % 3
    paths = examples.frame_paths(F.concat(F.lit("/c/"), F.col("user_id").cast("string")), n)
    messages = text.build_messages(
        paths, F.concat(F.lit("P"), n.cast("string")), F.lit("[]"), 1 + F.col("k") % 30, "image", True
    )
    return _message_rows(rows, "event_id", messages).drop("video", "fps")


@query(
    "build_api_messages",
    """
with c as (select conv_id || ':' || turn as example_id, base64(encode(role)) as a, base64(encode(text)) as b from conversations)
select example_id, 0 as turn, 'user' as role, 0 as item, 'text' as type, 'Frame F00:' as text, null::varchar as url from c
union all select example_id, 0, 'user', 1, 'image_url', null, 'data:image/png;base64,' || a from c
union all select example_id, 0, 'user', 2, 'text', 'Frame F01:', null from c
union all select example_id, 0, 'user', 3, 'image_url', null, 'data:image/png;base64,' || b from c
union all select example_id, 0, 'user', 4, 'text', 'P', null from c""",
)
def _(spark, sf_dir):
    rows = I.table(spark, sf_dir, "conversations").withColumn("example_id", F.concat_ws(":", "conv_id", "turn"))
    images = F.array(F.col("role").cast("binary"), F.col("text").cast("binary"))
    listed = _message_rows(rows, "example_id", text.build_api_messages(images, F.lit("P"), True))
    return listed.withColumn("url", F.col("image_url")["url"]).drop("image_url")


@query(
    "target_json",
    """
select recording_id, chunk, '[' || string_agg('{"frame":"' || frame || '","type":"' || type || '","details":"' || details || '"}', ',' order by cast(substr(frame, 2) as int), pos) || ']' as target
from clip_actions group by 1, 2""",
)
def _(spark, sf_dir):
    clips = C.nest_actions(I.clips(spark, sf_dir), I.clip_actions(spark, sf_dir))
    return clips.select(*CLIP, text.target_json(F.col("actions")).alias("target"))


@query(
    "select_frames_fps",
    """
select recording_id, chunk, cast(i as int) as new_frame, cast(least(floor(i / 2.0::double * 5 + 0.5), num_frames - 1) as int) as source_frame
from (select *, unnest(range(0, cast(floor((num_frames - 1) / 5.0::double * 2) as int) + 1)) as i from clips)""",
)
def _(spark, sf_dir):
    return C.selected_frames(I.clips(spark, sf_dir)).select(*CLIP, "new_frame", "source_frame")


@query(
    "remap_action_frames",
    """
select recording_id, chunk, pos, printf('F%02d', cast(least(floor(cast(substr(frame, 2) as int) / 5.0::double * 2 + 0.5), 9) as int)) as frame,
 type, details, 10 as num_frames from clip_actions""",
)
def _(spark, sf_dir):
    return C.remap_actions(I.clip_actions(spark, sf_dir).withColumn("num_frames", F.lit(I.CLIP_FRAMES)))


# --- state and windows ---------------------------------------------------------------------


def _state_rows(spark, sf_dir) -> DataFrame:
    log = I.keylog(spark, sf_dir)
    rows = spans.state_rows(spans.in_frames(log, I.FPS, I.FRAMES))
    return split_hot(rows, REC, counted=log)


@query(
    "held_modifiers",
    "select recording_id, ord, held_shift, held_altgr, held_cmd, false as held_ctrl, false as held_alt from held",
)
def _(spark, sf_dir):
    held = spans.held_before(_state_rows(spark, sf_dir))
    return held.select("recording_id", "ord", *[f"held_{m.lower()}" for m in names.MODIFIERS])


def _closed(spark, sf_dir, device: str) -> DataFrame:
    found = framed_spans(I.keylog(spark, sf_dir), I.FPS, I.FRAMES)
    return found.where(F.col("device") == device).select("recording_id", "name", "details", "start_frame", "end_frame")


@query("key_spans", "select recording_id, name, details, start_frame, cast(end_frame as int) as end_frame from spans where device = 'key'")
def _(spark, sf_dir):
    return _closed(spark, sf_dir, "key")


@query("button_spans", "select recording_id, name, details, start_frame, cast(end_frame as int) as end_frame from spans where device = 'button'")
def _(spark, sf_dir):
    return _closed(spark, sf_dir, "button")


@query(
    "context_release",
    """
select s.recording_id, s.device, s.name, s.start_frame, s.released_frame from spans s
join held h on h.recording_id = s.recording_id and h.etype = 'ContextChanged' and s.seq[1] = h.ts_us and s.seq[2] = h.ord""",
)
def _(spark, sf_dir):
    """Spans that a context release ends."""
    held = spans.hold_spans(_state_rows(spark, sf_dir))
    ends = F.struct(F.col("seq.ts_us").alias("ts_us"), F.col("seq.ord").alias("ord"))
    left = _state_rows(spark, sf_dir).where("releases_all").select("recording_id", F.struct("ts_us", "ord").alias("at"))
    return (
        held.withColumn("at", ends).join(left, ["recording_id", "at"], "left_semi")
        .select("recording_id", "device", "name", "start_frame", "released_frame")
    )


@query(
    "close_open_spans",
    "select recording_id, device, name, details, start_frame, end_frame from gt_spans",
)
def _(spark, sf_dir):
    log = I.truth_log(spark, sf_dir)
    framed = spans.in_rounded_frames(log, I.FPS)
    rows = split_hot(spans.state_rows(framed), REC, counted=log)
    closed = spans.close_open_spans(spans.hold_spans(rows), spans.last_frame_of_log(framed))
    return closed.select("recording_id", "device", "name", "details", "start_frame", "end_frame")


@query("explode_spans", "select recording_id, frame_idx, type, details from key_frames")
def _(spark, sf_dir):
    found = framed_spans(I.keylog(spark, sf_dir), I.FPS, I.FRAMES)
    return spans.explode_spans(found, I.FRAMES).drop("seq")


@query("scroll_per_frame", "select recording_id, frame, delta from scrolled")
def _(spark, sf_dir):
    return gestures.scroll_per_frame(spans.in_frames(I.keylog(spark, sf_dir), I.FPS, I.FRAMES))


@query("scroll_gestures", "select recording_id, frame_idx, type, details from gestures")
def _(spark, sf_dir):
    moved = gestures.scroll_per_frame(spans.in_frames(I.keylog(spark, sf_dir), I.FPS, I.FRAMES))
    return gestures.scroll_gestures(moved)


def _actions(spark, sf_dir) -> DataFrame:
    return parse_keylog(I.keylog(spark, sf_dir), I.FPS, I.FRAMES)


def _truth(spark, sf_dir) -> DataFrame:
    return gt_actions(I.truth_log(spark, sf_dir), I.FPS)


@query("parse_keylog", "select recording_id, frame_idx, type, details from actions")
def _(spark, sf_dir):
    return _actions(spark, sf_dir).drop("seq")


@query("gt_actions", "select recording_id, frame, type, detail from gt")
def _(spark, sf_dir):
    return _truth(spark, sf_dir).drop("seq")


@query(
    "coalesce_scroll_list",
    """
select recording_id, frame_idx, type, details, pos from (
 select *, lag(type) over w as pt, lag(details) over w as pd, lag(frame_idx) over w as pf
 from (select recording_id, pos, type, details, cast(replace(frame, 'F', '') as int) as frame_idx from preds)
 window w as (partition by recording_id order by pos))
where not coalesce(type = 'MouseScroll' and pt = 'MouseScroll' and pd = details and frame_idx <= pf + 1, false)""",
)
def _(spark, sf_dir):
    listed = I.preds(spark, sf_dir).select(
        "recording_id", "pos", "type", "details", fn.frame_of_label(F.col("frame")).alias("frame_idx")
    )
    return gestures.coalesce_scroll_list(listed, REC)


def _merged_clips(spark, sf_dir) -> DataFrame:
    numbered = I.clip_actions(spark, sf_dir).withColumn("f", fn.frame_of_label(F.col("frame")))
    return gestures.coalesce_repeats(numbered, CLIP, "f")


@query("coalesce_actions", "select recording_id, chunk, pos, frame, type, details from clip_merged")
def _(spark, sf_dir):
    return _merged_clips(spark, sf_dir).drop("f")


@query("coalesce_gt", "select recording_id, frame, type, detail from gt_merged")
def _(spark, sf_dir):
    counted = merging_rows(I.truth_log(spark, sf_dir), I.FPS)
    return gestures.coalesce_gt(_truth(spark, sf_dir), REC, counted=counted).drop("seq")


BLACK = 0.45


@query("black_fraction", "select recording_id, frame_idx, black_fraction from images")
def _(spark, sf_dir):
    return FR.black_fractions(I.images(spark, sf_dir))


def _kept(spark, sf_dir) -> DataFrame:
    return FR.drop_black_frames(FR.black_fractions(I.images(spark, sf_dir)), BLACK)


@query("drop_black_frames", "select recording_id, frame_idx from kept")
def _(spark, sf_dir):
    return _kept(spark, sf_dir).select("recording_id", "frame_idx")


@query("reindex_frames", "select recording_id, frame_idx, type, details from reindexed")
def _(spark, sf_dir):
    moved = FR.reindex_events(I.frame_events(spark, sf_dir), _kept(spark, sf_dir))
    return moved.select("recording_id", "frame_idx", "type", "details")


@query(
    "chunk_clips",
    """
select e.recording_id, w.chunk, cast(e.frame_idx - w.start_frame as int) as frame_idx, e.type, e.details
from reindexed e join fr_windows w on w.recording_id = e.recording_id
 and e.frame_idx >= w.start_frame and e.frame_idx < w.start_frame + w.num_frames""",
)
def _(spark, sf_dir):
    moved = FR.reindex_events(I.frame_events(spark, sf_dir), _kept(spark, sf_dir), "num_frames")
    return C.chunk_events(moved, 12, 5).select(*CLIP, "frame_idx", "type", "details")


# --- joins ---------------------------------------------------------------------------------


@query(
    "keep_existing_clips",
    "select recording_id, chunk, num_frames from clips c where exists (select 1 from clip_actions a where a.recording_id = c.recording_id and a.chunk = c.chunk and a.pos % 3 = 0)",
)
def _(spark, sf_dir):
    found = I.clip_actions(spark, sf_dir).where("pos % 3 = 0")
    return C.keep_existing_clips(I.clips(spark, sf_dir), found, CLIP)


def _scored(spark, sf_dir) -> DataFrame:
    return I.scored_preds(spark, sf_dir)


@query(
    "candidate_pairs",
    """
select g.recording_id, g.type, g.detail, g.frame, g.n as n_truth, count(p.frame) as n_candidates, cast(min(abs(p.frame - g.frame)) as int) as nearest
from (select recording_id, type, detail, frame, count(*) as n from gt group by all) g
left join scored p on p.recording_id = g.recording_id and p.type = g.type and p.detail = g.detail and p.frame between g.frame - 2 and g.frame + 2
group by all""",
)
def _(spark, sf_dir):
    return matching.candidate_counts(_truth(spark, sf_dir), _scored(spark, sf_dir), REC, 2)


@query(
    "match_clip",
    """
with used_g as (select recording_id, type, detail, frame, count(*) as n from m_matched group by all),
 used_p as (select recording_id, type, detail, pred_frame as frame, count(*) as n from m_matched group by all)
select 'match' as outcome, recording_id, type, detail, frame as gt_frame, pred_frame, cast(abs(frame - pred_frame) as int) as frame_dist from m_matched
union all
select 'unmatched_gt', g.recording_id, g.type, g.detail, g.frame, null, null
from (select *, row_number() over (partition by recording_id, type, detail, frame) as r from gt) g
left join used_g u on u.recording_id = g.recording_id and u.type = g.type and u.detail = g.detail and u.frame = g.frame
where r > coalesce(u.n, 0)
union all
select 'unmatched_pred', p.recording_id, p.type, p.detail, null, p.frame, null
from (select *, row_number() over (partition by recording_id, type, detail, frame) as r from scored) p
left join used_p u on u.recording_id = p.recording_id and u.type = p.type and u.detail = p.detail and u.frame = p.frame
where r > coalesce(u.n, 0)""",
)
def _(spark, sf_dir):
    return matching.match_clip(_truth(spark, sf_dir), _scored(spark, sf_dir), REC, 2)


# --- aggregations and metrics --------------------------------------------------------------


def _windows(spark, sf_dir) -> DataFrame:
    whole = I.recordings(spark, sf_dir).withColumn("num_frames", F.lit(I.FRAMES))
    return C.clip_windows(whole, 30, 15)


def _clip_counts(spark, sf_dir) -> DataFrame:
    placed = C.chunk_events(_actions(spark, sf_dir).withColumn("num_frames", F.lit(I.FRAMES)), 30, 15)
    return C.clip_action_counts(_windows(spark, sf_dir), placed)


@query("clip_action_counts", "select recording_id, chunk, start_frame, num_frames, n_actions from k_clip_counts")
def _(spark, sf_dir):
    return _clip_counts(spark, sf_dir)


@query("prf", f"select event_id, {O._prf('(k % 7)', '(k % 5)', '(k % 3)')} from ev")
def _(spark, sf_dir):
    k = F.col("k")
    counts = I.events(spark, sf_dir).select("event_id", (k % 7).alias("tp"), (k % 5).alias("fp"), (k % 3).alias("fn"))
    return metrics.with_prf(counts).drop("tp", "fp", "fn")


def _scores(spark, sf_dir) -> DataFrame:
    return scoring.score(_truth(spark, sf_dir), _scored(spark, sf_dir), I.recordings(spark, sf_dir), REC, 2)


_ROLLUP = "level, recording_id, type, gt_count, pred_count, tp, fp, fn, precision, recall, f1"


@query("score_rollup", f"select {_ROLLUP} from rollup")
def _(spark, sf_dir):
    return _scores(spark, sf_dir)


_DOCUMENT_SCORES = "sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn"


@query(
    "summary_documents",
    f"""
with c as (
 select r.recording_id % 16 as document, r.recording_id, m.type, coalesce(m.tp, 0) as tp, coalesce(m.fp, 0) as fp,
  coalesce(m.fn, 0) as fn
 from recordings r left join m_counts m on m.recording_id = r.recording_id)
select *, {O._prf()} from (
 select 'overall' as level, document, null::varchar as type, null::bigint as recording_id, {_DOCUMENT_SCORES} from c group by 2
 union all select 'type', document, type, null, {_DOCUMENT_SCORES} from c where type is not null group by 2, 3
 union all select 'clip', document, null, recording_id, {_DOCUMENT_SCORES} from c group by 2, 4)""",
)
def _(spark, sf_dir):
    document = (F.col("recording_id") % 16).alias("document")
    solved = matching.match_frames(_truth(spark, sf_dir), _scored(spark, sf_dir), REC, 2)
    counts = matching.outcome_counts(solved, [*REC, "type"]).select("*", document)
    made = scoring.nested_summary(counts, I.recordings(spark, sf_dir).select("*", document), ["document"], REC)
    path = scratch_path(spark, "summaries")
    files.write_summary_documents(made, path)
    stored = spark.read.schema(made.schema).json(path)
    none, rec = F.lit(None).cast("string").alias("type"), F.lit(None).cast("bigint").alias("recording_id")
    fields = ["tp", "fp", "fn", "precision", "recall", "f1"]
    types = stored.select("document", F.explode("per_type").alias("type", "score"))
    clips = stored.select("document", F.inline("clips"))
    return (
        stored.select(F.lit("overall").alias("level"), "document", none, rec, "overall.*")
        .unionByName(types.select(F.lit("type").alias("level"), "document", "type", rec, "score.*"))
        .unionByName(clips.select(F.lit("clip").alias("level"), "document", none, *REC, *fields))
    )


@query(
    "score_report",
    "select level, recording_id, type, gt_count, pred_count, tp, fp, fn, "
    + ", ".join(f"round_even({c}, 4) as {c}, round_even({c}, 2) as {c}_2" for c in ("precision", "recall", "f1"))
    + " from rollup order by level = 'clip', level = 'type', type, recording_id",
)
def _(spark, sf_dir):
    return scoring.score_report(_scores(spark, sf_dir), REC)


def _f1(spark, sf_dir) -> DataFrame:
    events = _actions(spark, sf_dir).withColumn("num_frames", F.lit(I.FRAMES))
    placed = C.chunk_events(events, I.CLIP_FRAMES, I.CLIP_FRAMES)
    # The clip's list is in frame order; actions of one frame are alike to the matcher.
    truth = placed.select(*CLIP, "type", F.col("details").alias("detail"), F.col("frame_idx").alias("frame"), F.col("frame_idx").alias("pos"))
    said = I.clip_actions(spark, sf_dir).select(
        *CLIP, "type", F.col("details").alias("detail"), fn.frame_from_digits(F.col("frame")).alias("frame"), "pos"
    )
    whole = I.recordings(spark, sf_dir).withColumn("num_frames", F.lit(I.FRAMES))
    return matching.compute_f1(truth, said, C.clip_windows(whole, I.CLIP_FRAMES, I.CLIP_FRAMES), CLIP)


@query("compute_f1", "select recording_id, chunk, tp, fp, fn, precision, recall, f1 from f_scores")
def _(spark, sf_dir):
    return _f1(spark, sf_dir)


@query(
    "macro_f1",
    "select round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1 from f_scores",
)
def _(spark, sf_dir):
    means = scoring.macro(_f1(spark, sf_dir))
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


@query("micro_f1", f"select *, {O._prf()} from (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from f_scores)")
def _(spark, sf_dir):
    return scoring.micro(_f1(spark, sf_dir))


@query(
    "rescore_sweep",
    f"""
select tolerance, coalesced as coalesce, gt_count, pred_count, tp, fp, fn, {O._prf()} from (
 select tolerance, coalesced, sum(g)::bigint as gt_count, sum(p)::bigint as pred_count, sum(t)::bigint as tp,
  (sum(p) - sum(t))::bigint as fp, (sum(g) - sum(t))::bigint as fn
 from (select tolerance, coalesced, 1 as g, 0 as p, 0 as t from s_truth
  union all select tolerance, coalesced, 0, 1, 0 from s_preds
  union all select tolerance, coalesced, 0, 0, 1 from s_matched) group by 1, 2)""",
)
def _(spark, sf_dir):
    counted = merging_rows(I.truth_log(spark, sf_dir), I.FPS)
    truth, said = _truth(spark, sf_dir), _scored(spark, sf_dir)
    return scoring.rescore_sweep(truth, said, REC, [0, 1, 2, 5], counted=counted)


@query(
    "run_counts",
    """
select split, count(*) as recordings, count(*) filter (where n = 0) as failed_recordings, sum(n)::bigint as clips
from (select s.recording_id, s.split, count(c.chunk) as n from split s
 left join k_clip_counts c on c.recording_id = s.recording_id and c.n_actions >= 60 group by 1, 2) group by 1""",
)
def _(spark, sf_dir):
    split = sampling.split_recordings(I.recordings(spark, sf_dir), "recording_id")
    return reports.run_counts(split, _clip_counts(spark, sf_dir).where("n_actions >= 60"))


@query(
    "timing_stats",
    """
select round_even(sum(s), 1) as total_s, round_even(sum(s) / count(*), 2) as mean_s,
 round_even(list_sort(list(s))[count(*) // 2 + 1], 2) as median_s, round_even(max(s), 2) as max_s,
 round_even(sum(s) / count(*) * 2147 / 3600, 1) as estimated_h
from (select user_id, (max(event_id) - min(event_id)) / 1000.0::double as s from events group by 1)""",
)
def _(spark, sf_dir):
    return reports.timing_stats(_timed(spark, sf_dir, "s"), "s")


def _timed(spark, sf_dir, name: str) -> DataFrame:
    """A time for each recording."""
    seconds = (F.max("event_id") - F.min("event_id")) / F.lit(1000.0)
    return I.table(spark, sf_dir, "events").groupBy("user_id").agg(seconds.alias(name))


def _before_after(spark, sf_dir) -> DataFrame:
    """Clips with their actions counted before and after merging, and their split."""
    split = sampling.split_recordings(I.recordings(spark, sf_dir), "recording_id")
    listed = I.clip_actions(spark, sf_dir).withColumn("f", fn.frame_of_label(F.col("frame")))
    merged = gestures.coalesce_repeats(listed, CLIP, "f")
    both = listed.select(*CLIP, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        merged.select(*CLIP, F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    counts = both.groupBy(*CLIP).agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))
    joined = I.clips(spark, sf_dir).join(counts, CLIP, "left").na.fill({"n_before": 0, "n_after": 0})
    return joined.join(split, "recording_id")


_BEFORE_AFTER = """
select c.recording_id, c.chunk, s.split, coalesce(b.n, 0) as n_before, coalesce(a.n, 0) as n_after
from clips c join split s on s.recording_id = c.recording_id
left join (select recording_id, chunk, count(*) as n from clip_actions group by 1, 2) b on b.recording_id = c.recording_id and b.chunk = c.chunk
left join (select recording_id, chunk, count(*) as n from clip_merged group by 1, 2) a on a.recording_id = c.recording_id and a.chunk = c.chunk"""


@query(
    "coalesce_report",
    f"""
select split, count(*) as clips, sum(n_before)::bigint as before, sum(n_after)::bigint as after,
 count(*) filter (where n_after = 0) as empty_clips, 100 * (1 - sum(n_after)::double / greatest(sum(n_before), 1)) as removed_pct
from ({_BEFORE_AFTER}) group by 1""",
)
def _(spark, sf_dir):
    return reports.coalesce_report(_before_after(spark, sf_dir))


# --- sampling and ordering -----------------------------------------------------------------


@query("split_recordings", "select recording_id, split from split")
def _(spark, sf_dir):
    return sampling.split_recordings(I.recordings(spark, sf_dir), "recording_id")


_CLIP_ID = "recording_id || '_' || chunk"


@query(
    "sample_negatives",
    f"select recording_id, chunk, n_actions from k_clip_counts where n_actions >= 60 or {O._hash(_CLIP_ID)} / 4294967296.0::double < 0.05",
)
def _(spark, sf_dir):
    counted = _clip_counts(spark, sf_dir).withColumn("clip_id", F.concat_ws("_", *CLIP))
    return sampling.sample_negatives(counted, "clip_id", "n_actions", 60, 0.05).select(*CLIP, "n_actions")


@query("drop_empty_clips", f"select recording_id, chunk, n_after as n_actions from ({_BEFORE_AFTER}) where n_after > 0")
def _(spark, sf_dir):
    counted = _before_after(spark, sf_dir).withColumnRenamed("n_after", "n_actions")
    return C.drop_empty_clips(counted).select(*CLIP, "n_actions")


@query("sample_validation", f"select recording_id, chunk from clips order by {O._hash(_CLIP_ID)}, {_CLIP_ID} limit 50")
def _(spark, sf_dir):
    named = I.clips(spark, sf_dir).withColumn("clip_id", F.concat_ws("_", *CLIP))
    return sampling.sample_validation(named, "clip_id", 50).select(*CLIP)


@query(
    "shard_clips",
    "select recording_id, chunk, cast((row_number() over (order by recording_id, chunk) - 1) % 8 as int) as shard from clips",
)
def _(spark, sf_dir):
    return sampling.shard_clips(I.clips(spark, sf_dir), CLIP, 8).select(*CLIP, "shard")


@query("assign_batches", "select example_id, batch_id from batched")
def _(spark, sf_dir):
    return sampling.assign_batches(_masked(spark, sf_dir), "example_id", 8).select("example_id", "batch_id")


@query("ordered_actions", "select recording_id, frame_idx, type, details from actions order by recording_id, frame_idx, type, details limit 100")
def _(spark, sf_dir):
    """A top-k report: the first actions in order."""
    order = ["recording_id", "frame_idx", "type", "details"]
    return _actions(spark, sf_dir).select(*order).orderBy(*order).limit(100)


# --- training examples ---------------------------------------------------------------------

MAX_TOKENS = 64


def _joined(*columns: str) -> list:
    return [F.array_join(F.transform(c, lambda t: t.cast("string")), ",").alias(c) for c in columns]


def _sql_joined(*columns: str) -> str:
    return ", ".join(f"coalesce(array_to_string({c}, ','), '') as {c}" for c in columns)


def _cut(spark, sf_dir) -> DataFrame:
    return I.tokens(spark, sf_dir).withColumn("ids", tokens.truncate_tokens(F.col("ids"), MAX_TOKENS))


def _masked(spark, sf_dir) -> DataFrame:
    found = I.tokens(spark, sf_dir).withColumn("plen", tokens.find_prompt_len(F.col("ids"), I.MARKER))
    return found.withColumn("labels", tokens.mask_labels(F.col("ids"), F.col("plen")))


@query("truncate_tokens", f"select example_id, {_sql_joined('ids')} from cut_tokens")
def _(spark, sf_dir):
    return _cut(spark, sf_dir).select("example_id", *_joined("ids"))


@query("find_prompt_len", "select example_id, cast(plen as int) as plen from masked")
def _(spark, sf_dir):
    return _masked(spark, sf_dir).select("example_id", "plen")


@query("mask_labels", f"select example_id, {_sql_joined('labels')} from masked")
def _(spark, sf_dir):
    return _masked(spark, sf_dir).select("example_id", *_joined("labels"))


@query("prompt_slice", f"select example_id, {_sql_joined('ids')} from (select example_id, ids[1:plen] as ids from masked)")
def _(spark, sf_dir):
    prompt = tokens.prompt_slice(F.col("ids"), F.col("labels"))
    return _masked(spark, sf_dir).withColumn("ids", prompt).select("example_id", *_joined("ids"))


@query(
    "collate_batch",
    f"""
select example_id, batch_id, {_sql_joined('ids', 'labels', 'attention_mask')} from (
 select example_id, batch_id, list_concat(ids, list_transform(range(0, w - len(ids)), lambda i: 0)) as ids,
  list_concat(labels, list_transform(range(0, w - len(ids)), lambda i: -100)) as labels,
  list_concat(list_transform(ids, lambda i: 1), list_transform(range(0, w - len(ids)), lambda i: 0)) as attention_mask
 from (select *, max(len(ids)) over (partition by batch_id) as w from batched))""",
)
def _(spark, sf_dir):
    batches = sampling.assign_batches(_masked(spark, sf_dir), "example_id", 8)
    padded = tokens.collate_batch(batches)
    return padded.select("example_id", "batch_id", *_joined("ids", "labels", "attention_mask"))


@query(
    "sft_examples",
    f"""
with a as (select recording_id, chunk, '[' || string_agg('{{"frame":"' || frame || '","type":"' || type || '","details":"' || {_RENAMED} || '"}}', ',' order by cast(substr(frame, 2) as int), pos) || ']' as target
 from ({_SPELLED_ACTIONS}) where not contains(details, 'Unknown(') group by 1, 2),
c as (select c.recording_id, c.chunk, num_frames, coalesce(target, '[]') as target, 'clips/' || c.recording_id || '_' || c.chunk as dir from clips c left join a on a.recording_id = c.recording_id and a.chunk = c.chunk)
select 'clips/' || recording_id || '_' || chunk as clip_dir, target, len(target) as n_target,
 dir || '/' || printf('F%02d', num_frames - 1) || '.jpg' as last_frame, num_frames as n_frames,
 printf('There are %d frames total (F00 to F%02d).', num_frames, num_frames - 1) as sentence from c""",
)
def _(spark, sf_dir):
    actions = _spelled(I.clip_actions(spark, sf_dir))
    clips = C.nest_actions(I.clips(spark, sf_dir), actions).select(
        F.concat(F.lit("clips/"), F.concat_ws("_", *CLIP)).alias("clip_dir"), "num_frames", F.lit(I.FPS).alias("fps"), "actions"
    )
    made = examples.sft_examples(clips)
    user, answer = F.col("messages")[0]["content"], F.col("messages")[1]["content"]
    video = user[0]["video"]
    return made.select(
        "clip_dir",
        answer[0]["text"].alias("target"),
        F.length("target").cast("bigint").alias("n_target"),
        F.element_at(video, -1).alias("last_frame"),
        F.size(video).alias("n_frames"),
        F.regexp_extract(user[1]["text"], r"(There are \d+ frames total \(F00 to F\d+\)\.)", 1).alias("sentence"),
    )

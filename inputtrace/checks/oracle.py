"""SQL counterparts of the registered queries, for an engine that reads the same tables.

The statements follow the definitions row by row (lists, recursion, ordered windows) and share
no approach with the plans they check.
"""

from __future__ import annotations

import re

from ..functions import names, text

SEED = 42


def _hash(key: str, seed: int = SEED) -> str:
    return f"('0x' || substr(md5(cast({key} as varchar) || ':{seed}'), 1, 8))::bigint"


def _label(frame: str) -> str:
    return f"printf('F%02d', {frame})"


def _case(column: str, pairs: dict[str, str], other: str) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in pairs.items())
    return f"case {column} {whens} else {other} end"


# The names that change, of the keys that the tables produce.
_SHIFTED = {raw: name for raw, name in names.KEY_NAMES.items() if raw != name}


def _normal(raw: str) -> str:
    other = (
        f"case when regexp_full_match({raw}, 'Key.') then upper({raw}[4]) "
        f"when regexp_full_match({raw}, 'Digit.') then {raw}[6] else {raw} end"
    )
    return _case(raw, _SHIFTED, other)


def _prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    p = f"coalesce({tp}::double / nullif({tp} + {fp}, 0), 0.0)"
    r = f"coalesce({tp}::double / nullif({tp} + {fn}, 0), 0.0)"
    return (
        f"{p} as precision, {r} as recall, "
        f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0.0) as f1"
    )


CTES: dict[str, str] = {}

CTES["ev"] = "select event_id, user_id, ts, cast(json_extract_string(props, '$.k') as int) as k from events"

CTES["keylog"] = """
select user_id as recording_id, event_id as ord,
 cast((epoch_us(ts) - 1704067200000000) // 86400 as bigint) as ts_us,
 case when event_id%16<=5 then 'KeyPress' when event_id%16<=10 then 'KeyRelease'
      when event_id%16=11 then 'MousePress' when event_id%16=12 then 'MouseRelease'
      when event_id%16<=14 then 'MouseScroll' when k<30 then 'ContextChanged' else 'MouseMove' end as etype,
 case k%8 when 0 then 'KeyA' when 1 then 'KeyB' when 2 then 'KeyC' when 3 then 'ShiftLeft'
      when 4 then 'MetaLeft' when 5 then 'Return' when 6 then 'Digit1' else 'AltGr' end as raw_key,
 case when k%3=0 then 'Right' else 'Left' end as button,
 cast(k%3-1 as double) as dx, cast(k%5-2 as double) as dy
from ev"""

CTES["framed"] = """
select * from (select *, cast(floor(ts_us * 5 / 1000000) as int) as frame from keylog)
where frame >= 0 and frame < 150"""

CTES["truth_log"] = "select *, 0.5::double * (recording_id % 3) as start_s from keylog"

CTES["gt_framed"] = """
select * from (
 select *, cast(round_even((ts_us::double - start_s * 1e6) / 1e6 * 5, 0) as int) as frame from truth_log)
where frame >= 0"""


def _state(framed: str, prefix: str, last: str, join: str = "") -> None:
    """Held modifiers, spans and clicks over a framed log, by rows replicated to every key."""

    def held(name: str, raw: str) -> str:
        return (
            f"coalesce(last_value(case when etype = 'ContextChanged' then false "
            f"when raw_key = '{raw}' and etype in ('KeyPress', 'KeyRelease') then etype = 'KeyPress' end "
            f"ignore nulls) over w, false) as {name}"
        )

    CTES[f"{prefix}held"] = f"""
select *, {held('held_shift', 'ShiftLeft')}, {held('held_altgr', 'AltGr')}, {held('held_cmd', 'MetaLeft')}
from {framed}
where etype in ('KeyPress', 'KeyRelease', 'MousePress', 'MouseRelease', 'ContextChanged')
window w as (partition by recording_id order by ts_us, ord rows between unbounded preceding and 1 preceding)"""
    CTES[f"{prefix}devices"] = f"""
select recording_id, ts_us, ord, frame, 'key' as device, {_normal('raw_key')} as name,
 case when held_cmd then 'Cmd+' else '' end || case when held_shift then 'Shift+' else '' end || {_normal('raw_key')} as details,
 case when etype = 'KeyPress' then 'P' else 'R' end as kind
from {prefix}held where etype in ('KeyPress', 'KeyRelease') and raw_key not in ('ShiftLeft', 'MetaLeft', 'AltGr')
union all
select recording_id, ts_us, ord, frame, 'button', button, button, case when etype = 'MousePress' then 'P' else 'R' end
from {prefix}held where etype in ('MousePress', 'MouseRelease')"""
    CTES[f"{prefix}replicated"] = f"""
select * from {prefix}devices
union all
select c.recording_id, c.ts_us, c.ord, c.frame, d.device, d.name, null, 'C'
from {prefix}held c join (select distinct recording_id, device, name from {prefix}devices) d using (recording_id)
where c.etype = 'ContextChanged'"""
    CTES[f"{prefix}spans"] = f"""
select z.recording_id, device, name, details, frame as start_frame, released.f as released_frame,
 coalesce(released.f, {last}) as end_frame,
 [coalesce(released.ts, 9007199254740992), coalesce(released.o, 9007199254740992), ts_us, ord] as seq
from (
 select *, lag(kind) over w as before_kind,
  first_value(case when kind <> 'P' then {{'f': frame, 'ts': ts_us, 'o': ord}} end ignore nulls) over
   (partition by recording_id, device, name order by ts_us, ord rows between 1 following and unbounded following) as released
 from {prefix}replicated
 window w as (partition by recording_id, device, name order by ts_us, ord)) z {join}
where kind = 'P' and coalesce(before_kind, 'R') <> 'P'"""


_state("framed", "", "149")
CTES["gt_last"] = "select recording_id, max(frame) as last_frame from gt_framed group by 1"
_state("gt_framed", "gt_", "l.last_frame", "join gt_last l on l.recording_id = z.recording_id")

CTES["key_frames"] = """
select recording_id, cast(unnest(range(start_frame, least(greatest(end_frame, start_frame + 1), 150))) as int) as frame_idx,
 'KeyPress' as type, details from spans where device = 'key'"""

CTES["scrolled"] = """
select recording_id, frame, sum(case when dy <> 0 then dy else dx end) as delta
from framed where etype = 'MouseScroll' and (dy <> 0 or dx <> 0) group by 1, 2"""

CTES["gestures"] = """
select recording_id, min(frame) as frame_idx, 'MouseScroll' as type,
 case when sum(delta) < 0 then 'down' else 'up' end as details
from (select *, sum(brk) over (partition by recording_id order by frame) as island
      from (select *, case when frame - lag(frame) over (partition by recording_id order by frame) <= 1 then 0 else 1 end as brk
            from scrolled))
group by recording_id, island having sum(delta) <> 0"""

CTES["actions"] = """
select recording_id, frame_idx, type, details from key_frames
union all select recording_id, start_frame, 'MouseClick', details from spans where device = 'button'
union all select recording_id, frame_idx, type, details from gestures"""

CTES["gt"] = """
select recording_id, cast(unnest(range(start_frame, greatest(end_frame, start_frame + 1))) as int) as frame,
 'KeyPress' as type, details as detail, seq from gt_spans where device = 'key'
union all select recording_id, start_frame, 'MouseClick', details, seq from gt_spans where device = 'button'
union all select recording_id, frame, 'MouseScroll', case when dy < 0 then 'down' else 'up' end, [ts_us, ord]
 from gt_framed where etype = 'MouseScroll' and dy <> 0"""

CTES["preds"] = f"""
select recording_id, ord as pos, case when fr < 0 then 'F-1' else {_label('fr')} end as frame,
 case etype when 'KeyPress' then 'KeyPress' when 'MousePress' then 'MouseClick' else 'MouseScroll' end as type,
 case when etype='MousePress' then button
      when etype='MouseScroll' then case when ord%9=0 then 'sideways' when dy<0 then 'Down' else 'up' end
      when ord%7=0 then lower(substr(raw_key,length(raw_key),1)) when ord%11=0 then 'cmd+c'
      when raw_key='Return' then 'enter' else substr(raw_key,length(raw_key),1) end as details
from (select *, cast(floor(ts_us*5/1000000) as int) + cast(ord%5 as int) - 2 as fr from keylog) z
where etype in ('KeyPress','MousePress','MouseScroll') and ord%6<>0"""

PREDICTED_KEY = (
    "case when details = 'cmd+c' then 'Cmd+C' when details = 'enter' then 'Return' "
    "when length(details) = 1 then upper(details) else details end"
)
CTES["scored"] = f"""
select recording_id, pos, cast(substr(frame, 2) as int) as frame, type,
 case when type = 'MouseScroll' then case when lower(details) in ('up', 'down') then lower(details) else '' end
      when type = 'KeyPress' then {PREDICTED_KEY}
      else details end as detail
from preds where frame <> 'F-1'"""

CTES["responses"] = """
select pos // 16 as response_id,
 case (pos // 16) % 4
  when 0 then body when 1 then '<think>x[1]</think>```json' || chr(10) || body || chr(10) || '```'
  when 2 then 'Answer: ' || body || ' done' else '<think>never closed ' || body end as raw_response
from (select min(pos) as pos, '[' || string_agg('{"frame":"' || frame || '","type":"' || type || '","details":"' || details || '"}', ',' order by pos) || ']' as body
      from preds group by pos // 16)"""

CTES["clip_actions"] = f"""
select recording_id, cast(f // 25 as int) as chunk, pos, {_label('f % 25')} as frame, type, details
from (select *, cast(regexp_extract(frame, 'F([0-9]+)', 1) as int) as f from preds where frame <> 'F-1')"""

CTES["clips"] = """
select recording_id, chunk, cast(1 + (recording_id * 7 + chunk * 3) % 40 as int) as num_frames
from (select distinct recording_id, chunk from clip_actions)"""

CTES["recordings"] = "select distinct user_id as recording_id from events"


def _merge(source: str, frame: str, details: str, keys: str, order: str = "pos") -> str:
    """Scrolls and clicks that repeat within one frame of the previous one removed."""
    return f"""
select * exclude (pf, pd) from (
 select *, lag({frame}) over w as pf, lag({details}) over w as pd from {source}
 where type in ('MouseScroll', 'MouseClick')
 window w as (partition by {keys}, type order by {frame}, {order}))
where not coalesce({frame} - pf <= 1 and {details} = pd, false)
union all select * from {source} where type = 'KeyPress'"""


CTES["clip_numbered"] = "select *, cast(substr(frame, 2) as int) as f from clip_actions"
CTES["clip_merged"] = _merge("clip_numbered", "f", "details", "recording_id, chunk")
CTES["gt_merged"] = _merge("gt", "frame", "detail", "recording_id", "seq")

CTES["images"] = """
select vec_id // 50 as recording_id, cast(vec_id % 50 as int) as frame_idx,
 len(list_filter(range(32), lambda i: floor(abs(embedding[2*i+1]::double) * 150) < 15
                                  and floor(abs(embedding[2*i+2]::double) * 150) < 15)) / 32.0::double as black_fraction
from embeddings"""
CTES["kept"] = "select * from images where black_fraction <= 0.45"
CTES["renumbered"] = """
select *, row_number() over (partition by recording_id order by frame_idx) - 1 as new_idx from kept"""
CTES["frame_events"] = """
select ord // 1000 as recording_id, cast(ord // 20 % 50 as int) as frame_idx, 'KeyPress' as type, raw_key as details from keylog"""
CTES["reindexed"] = """
select e.recording_id, cast(m.new_idx as int) as frame_idx, e.type, e.details
from frame_events e join renumbered m on m.recording_id = e.recording_id and m.frame_idx = e.frame_idx"""
CTES["frame_counts"] = "select recording_id, cast(count(*) as int) as num_frames from kept group by 1"


def _windows(source: str, length: int, stride: int) -> str:
    return f"""
select recording_id, cast(chunk as int) as chunk, cast(chunk * {stride} as int) as start_frame,
 cast(least({length}, n - chunk * {stride}) as int) as num_frames
from (select recording_id, num_frames as n, unnest(range(0, (greatest(1, num_frames - {length} + 1) - 1) // {stride} + 1)) as chunk from {source})"""


CTES["k_recordings"] = "select recording_id, 150 as num_frames from recordings"
CTES["k_windows"] = _windows("k_recordings", 30, 15)
CTES["k_clip_events"] = """
select a.recording_id, w.chunk, cast(a.frame_idx - w.start_frame as int) as frame_idx, a.type, a.details
from actions a join k_windows w on a.recording_id = w.recording_id
 and a.frame_idx >= w.start_frame and a.frame_idx < w.start_frame + w.num_frames"""
CTES["k_clip_counts"] = """
select w.recording_id, w.chunk, w.start_frame, w.num_frames, count(e.type) as n_actions
from k_windows w left join k_clip_events e on e.recording_id = w.recording_id and e.chunk = w.chunk
group by all"""
CTES["fr_windows"] = _windows("frame_counts", 12, 5)

CTES["split"] = f"""
select recording_id, case when rn <= floor(n * 0.85::double) then 'train' else 'val' end as split
from (select recording_id, row_number() over (order by {_hash('recording_id')}, recording_id) as rn, count(*) over () as n from recordings)"""

CTES["tokens"] = """
select conv_id || ':' || turn as example_id,
 list_concat(list_concat([1000, case role when 'user' then 1001 when 'system' then 1002 else 1003 end], lens[1:h]),
  list_concat(case when role = 'system' then [] else [1000, 1003] end, lens[h+1:])) as ids
from (select *, len(lens) // 2 as h from
 (select *, list_transform(string_split(text, ' '), lambda w: cast(length(w) as int)) as lens from conversations))"""

CTES["cut_tokens"] = "select example_id, ids[1:64] as ids from tokens"
CTES["masked"] = """
select example_id, ids, plen, list_transform(ids, lambda t, i: case when i <= plen then -100 else t end) as labels
from (select *, coalesce(list_max(list_filter(range(1, len(ids)), lambda i: ids[i] = 1000 and ids[i+1] = 1003)) + 1, 0) as plen from tokens)"""
CTES["batched"] = f"""
select * from (
 select *, (rn - 1) // 8 as batch_id, n // 8 as full_batches from (
  select *, row_number() over (order by {_hash('example_id')}, example_id) as rn, count(*) over () as n from masked))
where batch_id < full_batches"""


def _matching(prefix: str, truth: str, preds: str, keys: list[str], tolerance: str,
              truth_order: str = "frame", pred_order: str = "frame, pos") -> None:
    """Truth actions one after the other, each taking the nearest unused prediction."""
    k = ", ".join(keys)
    on = " and ".join(f"a.{c} = b.{c}" for c in keys)
    CTES[f"{prefix}_t"] = f"select {k}, frame, row_number() over (partition by {k} order by {truth_order}) as i from {truth}"
    CTES[f"{prefix}_p"] = f"select {k}, list(frame order by {pred_order}) as pf from {preds} group by {k}"
    CTES[f"{prefix}_walk"] = f"""
select {k}, pf, 0::bigint as i, []::bigint[] as used, null::int as frame, null::bigint as j from {prefix}_p
union all
select {k}, pf, i, case when best is null then used else list_append(used, best.j) end, frame, best.j
from (
 select {', '.join('a.' + c for c in keys)}, a.pf, b.i, a.used, b.frame,
  list_sort(list_filter(list_transform(range(1, len(a.pf) + 1), lambda j: {{'d': abs(a.pf[j] - b.frame), 'j': j}}),
   lambda x: x.d <= {tolerance} and not list_contains(a.used, x.j)))[1] as best
 from {prefix}_walk a join {prefix}_t b on {on} and b.i = a.i + 1)"""
    CTES[f"{prefix}_matched"] = f"select {k}, frame, pf[j] as pred_frame from {prefix}_walk where j is not null"


CLIP_KEYS = ["recording_id", "type", "detail"]
_matching("m", "gt", "scored", CLIP_KEYS, "2")

CTES["m_counts"] = """
select recording_id, type, sum(g)::bigint as gt_count, sum(p)::bigint as pred_count, sum(t)::bigint as tp,
 (sum(p) - sum(t))::bigint as fp, (sum(g) - sum(t))::bigint as fn
from (select recording_id, type, 1 as g, 0 as p, 0 as t from gt
 union all select recording_id, type, 0, 1, 0 from scored
 union all select recording_id, type, 0, 0, 1 from m_matched) group by 1, 2"""

_SUMS = "sum(gt_count)::bigint as gt_count, sum(pred_count)::bigint as pred_count, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn"
CTES["rollup"] = f"""
select *, {_prf()} from (
 select 'overall' as level, null::bigint as recording_id, null::varchar as type, {_SUMS} from m_counts
 union all select 'type', null, type, {_SUMS} from m_counts group by type
 union all select 'clip', r.recording_id, null, coalesce(sum(gt_count), 0)::bigint, coalesce(sum(pred_count), 0)::bigint,
  coalesce(sum(tp), 0)::bigint, coalesce(sum(fp), 0)::bigint, coalesce(sum(fn), 0)::bigint
 from recordings r left join m_counts c on c.recording_id = r.recording_id group by r.recording_id)"""

# Training-form actions of 25-frame clips: truth from the log, answers in their own order.
CTES["f_truth"] = """
select recording_id, frame_idx // 25 as chunk, cast(frame_idx % 25 as int) as frame, type, details as detail,
 frame_idx as pos from actions"""
CTES["f_preds"] = "select recording_id, chunk, cast(substr(frame, 2) as int) as frame, type, details as detail, pos from clip_actions"
_matching("f", "f_truth", "f_preds", ["recording_id", "chunk", "type", "detail"], "2", "pos", "pos")
CTES["f_clips"] = """
select recording_id, cast(unnest(range(0, 6)) as int) as chunk from recordings"""
CTES["f_scores"] = f"""
select recording_id, chunk, tp, fp, fn,
 case when g + p = 0 then 1.0::double else precision end as precision,
 case when g + p = 0 then 1.0::double else recall end as recall, case when g + p = 0 then 1.0::double else f1 end as f1
from (select *, {_prf()} from (
 select c.recording_id, c.chunk, coalesce(g, 0) as g, coalesce(p, 0) as p, coalesce(t, 0)::bigint as tp,
  (coalesce(p, 0) - coalesce(t, 0))::bigint as fp, (coalesce(g, 0) - coalesce(t, 0))::bigint as fn
 from f_clips c left join (
  select recording_id, chunk, sum(g) as g, sum(p) as p, sum(t) as t from (
   select recording_id, chunk, 1 as g, 0 as p, 0 as t from f_truth
   union all select recording_id, chunk, 0, 1, 0 from f_preds
   union all select recording_id, chunk, 0, 0, 1 from f_matched) group by 1, 2) s
  on s.recording_id = c.recording_id and s.chunk = c.chunk))"""

# Re-scoring: one copy of truth and predictions per setting.
CTES["s_settings"] = "select unnest([0, 1, 2, 5]) as tolerance"
CTES["s_truth"] = """
select tolerance, true as coalesced, recording_id, type, detail, frame from gt_merged, s_settings
union all select tolerance, false, recording_id, type, detail, frame from gt, s_settings"""
CTES["s_preds"] = """
select tolerance, coalesced, recording_id, type, detail, frame, pos
from scored, s_settings, (select unnest([true, false]) as coalesced)"""
_matching("s", "s_truth", "s_preds", ["tolerance", "coalesced", *CLIP_KEYS], "a.tolerance")


ONCE = {"keylog", "gt_framed", "held", "gt_held", "devices", "gt_devices", "spans", "gt_spans", "gt", "actions", "scored", "clip_actions"}


def sql(body: str) -> str:
    """A statement with the common table expressions it needs, in order of definition."""
    needed: set[str] = set()

    def visit(statement: str) -> None:
        for word in set(re.findall(r"[a-z_0-9]+", statement)):
            if word in CTES and word not in needed and re.search(rf"(from|join|,)\s+{word}\b", statement):
                needed.add(word)
                visit(CTES[word])

    visit(body)
    parts = []
    for name, statement in CTES.items():
        if name in needed:
            # Steps that are read more than once are computed once.
            kept = "materialized " if name in ONCE else ""
            parts.append(f"{name} as {kept}({statement})")
    # A statement may bring expressions of its own.
    own = body.lstrip().startswith("with ")
    joined = ", ".join(parts)
    if own and parts:
        return f"with recursive {joined}, {body.lstrip()[len('with '):]}"
    return f"with recursive {joined} {body}" if parts else body


"""Matching predicted actions to truth within a frame tolerance.

Each truth action, in order, takes the nearest free prediction of the same clip, type and
detail, the earlier one on ties. Equality on all three makes every (clip, type, detail) its own
problem, and actions of one frame are interchangeable, so each problem shrinks to counts per
frame before anything is gathered. What a truth frame may take lies within the tolerance, so a
range window supplies it; the remaining order dependence is a fold over those few counts.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import with_prf

PICKS = "array<struct<frame:int,id:bigint,pred_frame:int,n:bigint>>"
# Entries handled by one inner fold, so that a long problem is not copied at every step.
BLOCK = 1024


def _counts(truth: DataFrame, preds: DataFrame, keys: list[str]) -> DataFrame:
    """Truth and prediction counts per problem and frame."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = truth.select(*keys, "frame", one.alias("g"), zero.alias("p")).unionByName(
        preds.select(*keys, "frame", zero.alias("g"), one.alias("p"))
    )
    return both.groupBy(*keys, "frame").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))


def _within(counts: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Add ``near``, the predictions within the tolerance of each frame, and ``stretch``.

    A frame has one row, so what is in reach lies at most ``tolerance`` rows away. Stretches
    number the parts of a problem that cannot influence each other.
    """
    window = Window.partitionBy(*keys).orderBy("frame")
    frame, p = F.col("frame"), F.col("p")
    here = F.when(
        p > 0, F.struct(frame.cast("bigint").alias("id"), frame.alias("pred_frame"), p.alias("p"))
    )
    beside = [F.lag(here, i).over(window) for i in range(tolerance, 0, -1)]
    beside += [here] + [F.lead(here, i).over(window) for i in range(1, tolerance + 1)]
    gap = frame - F.lag("frame").over(window) > tolerance
    placed = counts.withColumns({"near": F.array_compact(F.array(*beside)), "_gap": F.coalesce(gap, F.lit(False)).cast("int")})
    return placed.withColumn("stretch", F.sum("_gap").over(window)).drop("_gap")


def _ranked(frame: Column, near: Column, limit: Column) -> Column:
    """Candidates within ``limit``, nearest first and then in their own order."""
    placed = F.transform(
        near,
        lambda c: F.struct(F.abs(c["pred_frame"] - frame).alias("d"), c["id"], c["pred_frame"], c["p"]),
    )
    return F.array_sort(F.filter(placed, lambda c: c["d"] <= limit))


def _take(entry: Column, taken: Column) -> Column:
    """What one truth entry takes from its candidates, given what is taken already."""
    start = F.struct(entry["g"].alias("left"), F.array().cast(PICKS).alias("picks"))

    def step(state: Column, c: Column) -> Column:
        used = F.aggregate(
            F.filter(taken, lambda t: t["id"] == c["id"]),
            F.lit(0).cast("bigint"),
            lambda total, t: total + t["n"],
        )
        n = F.least(state["left"], c["p"] - used)
        pick = F.struct(
            entry["frame"].alias("frame"), c["id"].alias("id"),
            c["pred_frame"].alias("pred_frame"), n.alias("n"),
        )
        return F.when(
            n > 0,
            F.struct(
                (state["left"] - n).alias("left"),
                F.concat(state["picks"], F.array(pick)).alias("picks"),
            ),
        ).otherwise(state)

    return F.aggregate(entry["cands"], start, step, lambda state: state["picks"])


def _fold(entries: Column, start: Column, reach: int) -> Column:
    """Let the entries take in order; ``reach`` forgets picks no later entry can meet."""

    def step(state: Column, entry: Column) -> Column:
        remembered = F.filter(state["taken"], lambda t: t["pred_frame"] >= entry["frame"] - F.lit(reach))
        # A one-element array binds the picks, which are needed twice.
        bound = F.transform(
            F.array(_take(entry, remembered)),
            lambda picks: F.struct(
                F.concat(remembered, picks).alias("taken"),
                F.concat(state["picks"], picks).alias("picks"),
            ),
        )
        return F.element_at(bound, 1)

    return F.aggregate(entries, start, step)


def _empty_state() -> Column:
    return F.struct(F.array().cast(PICKS).alias("taken"), F.array().cast(PICKS).alias("picks"))


def _picks(entries: Column, reach: int) -> Column:
    """All picks of a problem, folded block by block."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(entries) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(entries, b * BLOCK + 1, F.lit(BLOCK)),
    )

    def step(state: Column, block: Column) -> Column:
        inner = F.struct(state["taken"].alias("taken"), F.array().cast(PICKS).alias("picks"))
        bound = F.transform(
            F.array(_fold(block, inner, reach)),
            lambda done: F.struct(
                done["taken"].alias("taken"),
                F.concat(state["picks"], done["picks"]).alias("picks"),
            ),
        )
        return F.element_at(bound, 1)

    return F.aggregate(blocks, _empty_state(), step, lambda state: state["picks"])


def _solved(entries: str, reach: int) -> Column:
    """The picks of a stretch. Without a fold where nothing is in reach, and where no two entries ask
    for the same: one entry with one candidate, or entries that all have their own frame only."""
    listed = F.col(entries)
    single = F.forall(listed, lambda e: F.size(e["cands"]) == 1)
    apart = (F.size(listed) == 1) | F.forall(listed, lambda e: F.get(e["cands"], F.lit(0))["d"] == 0)

    def own(e: Column) -> Column:
        c = F.get(e["cands"], F.lit(0))
        n = F.least(e["g"], c["p"])
        return F.struct(e["frame"].alias("frame"), c["id"].alias("id"), c["pred_frame"].alias("pred_frame"), n.alias("n"))

    none = F.array().cast(PICKS)
    asked = F.coalesce(F.size(listed) > 0, F.lit(False))
    return F.when(~asked, none).when(single & apart, F.transform(listed, own).cast(PICKS)).otherwise(_picks(listed, reach))


def _stretches(counts: DataFrame, keys: list[str], tolerance: int, values: list[str]) -> DataFrame:
    """A row per part of a problem that no other part can influence: ``frames`` in order, with their
    ``values``, and the sums of these.

    Only counts are gathered; what is in reach of a frame lies beside it in ``frames``.
    """
    window = Window.partitionBy(*keys).orderBy("frame")
    gap = F.col("frame") - F.lag("frame").over(window) > tolerance
    placed = counts.withColumn("_gap", F.coalesce(gap, F.lit(False)).cast("int"))
    placed = placed.withColumn("stretch", F.sum("_gap").over(window)).drop("_gap")
    gathered = placed.groupBy(*keys, "stretch").agg(
        *[F.sum(c).alias(f"_{c}") for c in values],
        F.array_sort(F.collect_list(F.struct("frame", *values))).alias("frames"),
    )
    return gathered.drop("stretch")


def _entries(asked: Column, asks: list[str], tolerance: int) -> Column:
    """The truth frames of a stretch that have candidates, with these, where any is ``asked``.

    ``asks`` names the counts of truth, the largest first.
    """

    def entry(e: Column, i: Column) -> Column:
        first = F.greatest(i - tolerance, F.lit(0))
        here = F.filter(F.slice("frames", first + 1, i + tolerance + 1 - first), lambda c: c["p"] > 0)
        given = F.transform(
            here, lambda c: F.struct(c["frame"].cast("bigint").alias("id"), c["frame"].alias("pred_frame"), c["p"].alias("p"))
        )
        cands = F.when(e[asks[0]] > 0, _ranked(e["frame"], given, F.lit(tolerance)))
        return F.struct(e["frame"].alias("frame"), *[e[a].alias(a) for a in asks], cands.alias("cands"))

    return F.filter(F.transform(F.when(asked, F.col("frames")), entry), lambda e: F.size(e["cands"]) > 0)


def match_frames(
    truth: DataFrame, preds: DataFrame, clip: list[str], tolerance: int = 2
) -> DataFrame:
    """Matching of actions ordered by frame, solved per stretch of a (clip, type, detail).

    ``picks`` are the matches made, ``frames`` the counts they were made from.
    """
    keys = [*clip, "type", "detail"]
    stretches = _stretches(_counts(truth, preds, keys), keys, tolerance, ["g", "p"])
    both = (F.col("_g") > 0) & (F.col("_p") > 0)
    reached = stretches.withColumn("entries", _entries(both, ["g"], tolerance))
    return reached.select(
        *keys, F.col("_g").alias("gt_count"), F.col("_p").alias("pred_count"), "frames",
        _solved("entries", tolerance).alias("picks"),
    )


def match_settings(
    truth: DataFrame, preds: DataFrame, clip: list[str], tolerances: list[int]
) -> DataFrame:
    """The same for every tolerance, with plain truth and with merged scrolls and clicks.

    Truth is read once: ``kept`` tells which of its rows remain when merged. Rows are counted and
    gathered once, and each frame's candidates ranked once, under the widest tolerance; the
    settings multiply what has candidates and not the rows. A stretch of which merging takes
    nothing away is solved once for both.
    """
    keys = [*clip, "type", "detail"]
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def counted(rows: DataFrame, plain: Column, merged: Column, p: Column) -> DataFrame:
        return rows.select(*keys, "frame", plain.alias("plain"), merged.alias("merged"), p.alias("p"))

    every = counted(truth, one, F.col("kept").cast("bigint"), zero).unionByName(counted(preds, zero, zero, one))
    counts = every.groupBy(*keys, "frame").agg(*[F.sum(c).alias(c) for c in ("plain", "merged", "p")])
    widest = max(tolerances)
    stretches = _stretches(counts, keys, widest, ["plain", "merged", "p"])
    both = (F.col("_plain") > 0) & (F.col("_p") > 0)
    reached = stretches.withColumn("entries", _entries(both, ["plain", "merged"], widest)).drop("frames")
    differs = F.col("_plain") != F.col("_merged")

    def setting(t: int, asks: str, coalesce: Column) -> Column:
        def within(e: Column) -> Column:
            cands = F.filter(e["cands"], lambda c: c["d"] <= t)
            return F.struct(e["frame"].alias("frame"), e[asks].alias("g"), cands.alias("cands"))

        entries = F.filter(F.transform("entries", within), lambda e: (e["g"] > 0) & (F.size(e["cands"]) > 0))
        return F.struct(
            F.lit(t).alias("tolerance"),
            coalesce.alias("coalesce"),
            F.col(f"_{asks}").alias("gt_count"),
            F.col("_p").alias("pred_count"),
            entries.alias("entries"),
        )

    alone = F.when(differs, F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))
    rows = F.array(*[setting(t, "plain", alone) for t in tolerances])
    merged = F.when(differs, F.array(*[setting(t, "merged", F.array(F.lit(True))) for t in tolerances]))
    rows = F.explode(F.when(differs, F.concat(rows, merged)).otherwise(rows))
    chosen = reached.select(*keys, rows.alias("row")).select(*keys, "row.*")
    solved = chosen.withColumn("picks", _solved("entries", widest)).drop("entries")
    return solved.withColumn("coalesce", F.explode("coalesce"))


_PICKED = T.StructType(
    [T.StructField(name, T.ArrayType(kind)) for name, kind in (("frame", T.IntegerType()), ("pred_frame", T.IntegerType()), ("n", T.LongType()))]
)


def take_in_order(asked, asked_n, given, given_n, tolerance: int) -> list[tuple[int, int, int]]:
    """What each asked frame, in list order, takes of the given ones: the nearest that are left within the
    tolerance, of two equally near the earlier in the list. Triples of both frames and how many.

    The given places wait in a queue per frame, so an asked frame looks at ``2 * tolerance + 1`` heads
    and the work grows with the lists and not with their product.
    """
    waiting: dict[int, deque] = {}
    for place, (frame, n) in enumerate(zip(given, given_n)):
        waiting.setdefault(int(frame), deque()).append([place, int(n)])
    picks = []
    for frame, wanted in zip(asked, asked_n):
        frame, wanted = int(frame), int(wanted)
        for distance in range(tolerance + 1):
            beside = [f for f in {frame - distance, frame + distance} if f in waiting]
            while wanted and beside:
                nearest = min(beside, key=lambda f: waiting[f][0])
                head = waiting[nearest][0]
                n = min(wanted, head[1])
                picks.append((frame, nearest, n))
                wanted -= n
                head[1] -= n
                if not head[1]:
                    waiting[nearest].popleft()
                    if not waiting[nearest]:
                        del waiting[nearest]
                        beside.remove(nearest)
            if not wanted:
                break
    return picks


@F.pandas_udf(_PICKED)
def _take_in_order(
    asked: pd.Series, asked_n: pd.Series, given: pd.Series, given_n: pd.Series, tolerance: pd.Series
) -> pd.DataFrame:
    rows = []
    for row in zip(asked, asked_n, given, given_n, tolerance):
        picks = take_in_order(*row)
        rows.append(list(map(list, zip(*picks))) if picks else [[], [], []])
    return pd.DataFrame(rows, columns=["frame", "pred_frame", "n"])


def match_lists(truth: DataFrame, preds: DataFrame, clip: list[str], tolerance: int = 2) -> DataFrame:
    """Matching where the order of both lists is ``pos`` and not the frame, solved.

    Frames further apart than the tolerance cannot meet, so each stretch of frames is solved on
    its own: what is gathered is bounded by a stretch, and the result has a row per stretch.
    Neighbours in the list of a stretch with one frame form a run and are handled as a count.
    List order may jump between frames, which no window follows, so a stretch is solved in an
    Arrow function, in time that grows with its length.
    """
    keys = [*clip, "type", "detail"]
    columns = [*keys, "pos", "frame"]
    both = truth.select(*columns, F.lit(True).alias("asks")).unionByName(
        preds.select(*columns, F.lit(False).alias("asks"))
    )
    by_frame = Window.partitionBy(*keys).orderBy("frame")
    apart = F.col("frame") - F.lag("frame").over(by_frame) > tolerance
    both = both.withColumn("apart", F.when(apart, 1).otherwise(0))
    both = both.withColumn("stretch", F.sum("apart").over(by_frame)).drop("apart")
    keys = [*keys, "stretch"]
    window = Window.partitionBy(*keys).orderBy("asks", "pos")
    here, before = F.struct("asks", "frame"), F.lag(F.struct("asks", "frame")).over(window)
    marked = both.withColumn("_start", F.when(~here.eqNullSafe(before), F.col("pos")))
    runs = (
        marked.withColumn("id", F.last("_start", True).over(window))
        .groupBy(*keys, "asks", "id", "frame")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    zero = F.lit(0).cast("bigint")
    asked = F.struct("id", "frame", F.col("n").alias("g"), zero.alias("p"))
    given = F.struct("id", F.col("frame").alias("pred_frame"), F.col("n").alias("p"))
    gathered = runs.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("asks"), asked))).alias("asked"),
        F.array_sort(F.collect_list(F.when(~F.col("asks"), given))).alias("given"),
    )
    # What has no frame meets nothing.
    asking, offered = F.filter("asked", lambda x: x["frame"].isNotNull()), F.filter("given", lambda x: x["pred_frame"].isNotNull())
    found = _take_in_order(asking["frame"], asking["g"], offered["pred_frame"], offered["p"], F.lit(tolerance))
    picks = F.arrays_zip(found["frame"].alias("frame"), found["pred_frame"].alias("pred_frame"), found["n"].alias("n"))
    said = F.transform(
        "given", lambda c: F.struct(c["pred_frame"].alias("frame"), zero.alias("g"), c["p"].alias("p"))
    )
    listed = F.transform("asked", lambda e: F.struct(e["frame"].alias("frame"), e["g"].alias("g"), e["p"].alias("p")))
    return gathered.select(
        *keys,
        F.concat(listed, said).alias("frames"),
        picks.alias("picks"),
        _total("asked", "g").alias("gt_count"),
        _total("given", "p").alias("pred_count"),
    )


def _total(array: str, field: str) -> Column:
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda total, x: total + x[field])


def outcome_counts(solved: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn and the numbers of truth and predicted actions per ``by``."""
    counted = solved.select(*by, "gt_count", "pred_count", _total("picks", "n").alias("tp"))
    sums = counted.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("gt_count", "pred_count", "tp")])
    return sums.withColumns({"fp": F.col("pred_count") - F.col("tp"), "fn": F.col("gt_count") - F.col("tp")})


def match_clip(truth: DataFrame, preds: DataFrame, clip: list[str], tolerance: int = 2) -> DataFrame:
    """Matches and leftovers, one row per action (pair).

    ``outcome`` is ``match``, ``unmatched_gt`` or ``unmatched_pred``.
    """
    keys = [*clip, "type", "detail"]
    none = F.lit(None).cast("int")

    def row(outcome: str, gt_frame: Column, pred_frame: Column, n: Column) -> Column:
        return F.struct(
            F.lit(outcome).alias("outcome"),
            gt_frame.alias("gt_frame"),
            pred_frame.alias("pred_frame"),
            n.alias("n"),
        )

    # What is there counts up and what is used counts down; the rest is left over.
    rows = F.concat(
        F.transform("picks", lambda x: row("match", x["frame"], x["pred_frame"], x["n"])),
        F.transform("picks", lambda x: row("unmatched_gt", x["frame"], none, -x["n"])),
        F.transform("picks", lambda x: row("unmatched_pred", none, x["pred_frame"], -x["n"])),
        F.transform("frames", lambda x: row("unmatched_gt", x["frame"], none, x["g"])),
        F.transform("frames", lambda x: row("unmatched_pred", none, x["frame"], x["p"])),
    )
    solved = match_frames(truth, preds, clip, tolerance)
    counts = (
        solved.select(*keys, F.explode(F.filter(rows, lambda r: r["n"] != 0)).alias("r"))
        .groupBy("r.outcome", *keys, "r.gt_frame", "r.pred_frame")
        .agg(F.sum("r.n").alias("n"))
    )
    copies = counts.where("n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    distance = F.abs(F.col("gt_frame") - F.col("pred_frame"))
    return copies.withColumn("frame_dist", distance).drop("n", "_copy")


def candidate_counts(truth: DataFrame, preds: DataFrame, clip: list[str], tolerance: int = 2) -> DataFrame:
    """Per truth frame: truth actions, predictions within the tolerance, and the nearest one.

    Counts answer what the pairs would be listed for, and do not multiply the rows.
    """
    keys = [*clip, "type", "detail"]
    near = _within(_counts(truth, preds, keys), keys, tolerance).where("g > 0")
    reached = near.withColumn("cands", _ranked(F.col("frame"), F.col("near"), F.lit(tolerance)))
    return reached.select(
        *keys,
        "frame",
        F.col("g").alias("n_truth"),
        _total("cands", "p").alias("n_candidates"),
        F.get("cands", F.lit(0))["d"].alias("nearest"),
    )


def compute_f1(
    truth: DataFrame, preds: DataFrame, clips: DataFrame, clip: list[str], tolerance: int = 2
) -> DataFrame:
    """Precision, recall and f1 per clip of training-form actions in their given order.

    Both lists empty scores 1, one empty scores 0. Names are compared as they are. ``clips``
    lists the clips to score, so that clips without any action are scored too.
    """
    counts = outcome_counts(match_lists(truth, preds, clip, tolerance), clip)
    scored = with_prf(clips.select(*clip).distinct().join(counts, clip, "left").na.fill(0))
    nothing = (F.col("gt_count") == 0) & (F.col("pred_count") == 0)
    values = {
        name: F.when(nothing, F.lit(1.0)).otherwise(F.col(name))
        for name in ("precision", "recall", "f1")
    }
    return scored.withColumns(values).select(*clip, "tp", "fp", "fn", "precision", "recall", "f1")

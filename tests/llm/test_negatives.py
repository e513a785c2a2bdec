"""Cover trees and hard negatives against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inputtrace.llm import negatives
from inputtrace.llm.common import stored


def vectors(n, seed, width=8, spread=0.6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, width))
    near = centers[rng.integers(0, 6, n)] + rng.normal(size=(n, width)) * spread
    return near * rng.uniform(0.2, 1.5, (n, 1))


def model(rows, positives=5, number=5, low=80):
    kept = [
        (i, vec, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, (vec, v, label) in enumerate(rows)
        if vec is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    found = []
    for row, vec, label, v in kept:
        if vec % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), other, k, l) for k, other, l, w in kept if k != row)
        for p in [s for s in scored if s[3] == label][:positives]:
            fits = [s for s in scored if s[3] != label and -low * p[0] <= -100 * s[0] <= -100 * p[0]]
            found += [(vec, p[1], i, s[1], -p[0], -s[0]) for i, s in enumerate(fits[:number], 1)]
    return sorted(found)


@pytest.mark.parametrize("leaf,spread", [(1, 0.6), (16, 0.05), (4, 0.0)])
def test_bounds_hold(leaf, spread):
    data = np.floor(256 * vectors(400, 3, spread=spread)).astype(np.int64)
    asked = np.floor(256 * vectors(20, 9)).astype(np.int64)
    asked[0] = 0
    tree = negatives.CoverTree(data, leaf)
    assert sorted(tree.order) == list(range(400))
    least, most = tree.bounds(asked)
    scores = asked @ data.T
    for node, (a, b) in enumerate(tree.span):
        below = scores[:, tree.order[a:b]]
        assert (below >= least[:, [node]]).all() and (below <= most[:, [node]]).all()
        first, end = tree.kids[node]
        if first < end:
            assert sorted(sum((list(range(*tree.span[k])) for k in range(first, end)), [])) == list(range(a, b))
            assert tree.center[first] == tree.center[node]


def test_descent_finds_the_best_and_skips():
    data = np.floor(256 * vectors(3000, 5, spread=0.05)).astype(np.int64)
    asked = np.floor(256 * vectors(30, 6)).astype(np.int64)
    tree = negatives.CoverTree(data)
    ids = np.random.default_rng(1).integers(0, 900, len(data))
    scores = asked @ data.T
    verified = []
    high = np.sort(scores, axis=1)[:, -40].astype(float)
    for low, top in ((np.full(30, -np.inf), np.full(30, np.inf)), (0.8 * high, high)):
        allowed = lambda q, at: verified.append(len(at)) or at % 3 > q % 2
        who, score, place = tree.best(asked, tree.bounds(asked), 5, low, top, ids, allowed)
        for i in range(30):
            want = sorted((-int(s), int(ids[j]), j) for j, s in enumerate(scores[i]) if j % 3 > i % 2 and low[i] <= s <= top[i])[:5]
            assert list(zip(-score[who == i], ids[place[who == i]], place[who == i])) == want
    assert sum(verified) < 0.5 * scores.size * 2


def test_large_components_stay_exact():
    a = np.array([[1 << 30, 3]]), np.array([[(1 << 30) + 1, 5], [1, 1]])
    assert negatives.products(*a).tolist() == [[(1 << 60) + (1 << 30) + 15, (1 << 30) + 3]]


def table_of(spark, rows):
    return stored(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), "test-vectors")


@pytest.mark.parametrize("block", [64, 4096])
def test_hard_negatives(spark, block):
    rng = np.random.default_rng(8)
    data = vectors(700, 11).astype(np.float32)
    data[300:420] = data[300]  # one vector in many copies, ties by id
    rows = [(int(i) * 20, [float(x) for x in v], int(rng.integers(0, 4)) if i % 3 else 1) for i, v in enumerate(data)]
    rows += [rows[5], rows[5], (100, rows[5][1], 2), (None, rows[1][1], 1), (300, None, 1), (500, [None] * 8, 2), (700, [float("nan")] * 8, 2)]
    rows += [(900, [float("inf")] + [0.0] * 7, 2), (1100, rows[3][1], None), (1300, [1.0, 2.0], 1), (1500, [], 1), (1700, [0.0] * 8, 2)]
    docs = table_of(spark, rows).select("*", *[F.lit(1).alias(c) for c in ("row", "v", "block", "part", "n", "score")])
    found = negatives.hard_negatives(docs, F.col("vec_id") % 100 == 0, F.col("label"), block=block).collect()
    assert sorted(map(tuple, found)) == model(rows)


def test_no_rows(spark):
    for rows in ([], [(100, [1.0], 1)], [(100, [1.0], 1), (200, [1.0], 2)]):
        assert negatives.hard_negatives(table_of(spark, rows), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def test_small_blocks_hold_all_rows(spark):
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors(900, 2))]
    whole = negatives.prepared(table_of(spark, rows), "vec_id", "embedding", F.col("label"))
    blocks = negatives.Blocks(whole, 50)
    sizes = [r["count"] for r in blocks.rows.groupBy("block").count().collect()]
    assert sum(sizes) == 900 and max(sizes) <= 120 and len(sizes) >= 18
    assert {r["block"] for r in blocks.rows.select("block").distinct().collect()} <= set(range(blocks.count))

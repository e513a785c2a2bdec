"""Nested score documents, written and read back."""

from inputtrace.operators.scoring import nested_summary, score_rollup
from inputtrace.sources import files

COUNTS = "document string, clip_index int, clip_name string, type string, gt_count bigint, pred_count bigint, tp bigint, fp bigint, fn bigint"
FIELDS = ("tp", "fp", "fn", "precision", "recall", "f1")


def slow(rows):
    tp, fp, fn = (sum(r[i] for r in rows) for i in (6, 7, 8))
    p, r = (tp / (tp + fp) if tp + fp else 0.0), (tp / (tp + fn) if tp + fn else 0.0)
    return tp, fp, fn, p, r, (2 * p * r / (p + r) if p + r else 0.0)


def same(found, want):
    return all(abs(found[f] - w) < 1e-12 for f, w in zip(FIELDS, want))


def test_documents_hold_their_own_scores(spark, tmp_path):
    rows = [
        ("a", i, f"clip{i}", kind, tp + fn, tp + fp, tp, fp, fn)
        for i in range(12) for kind, tp, fp, fn in (("KeyPress", i, 1, 2), ("MouseScroll", 0, i % 2, 1))
    ]
    rows += [("b", 0, "clip0", "KeyPress", 3, 3, 3, 0, 0)]
    clips = [(d, i, f"clip{i}") for d, n in (("a", 14), ("b", 1), ("c", 1)) for i in range(n)]
    counts = spark.createDataFrame(rows, COUNTS)
    clips = spark.createDataFrame(clips + clips[:1], "document string, clip_index int, clip_name string")
    made = nested_summary(counts, clips, ["document"], ["clip_index", "clip_name"])
    path = str(tmp_path / "summary")
    files.write_summary_documents(made, path)
    found = {r["document"]: r for r in spark.read.schema(made.schema).json(path).collect()}
    assert sorted(found) == ["a", "b", "c"]
    for name, clip_count in (("a", 14), ("b", 1), ("c", 1)):
        own, document = [r for r in rows if r[0] == name], found[name]
        assert same(document["overall"], slow(own))
        assert {t: True for t in document["per_type"]} == {r[3]: True for r in own}
        assert all(same(s, slow([r for r in own if r[3] == t])) for t, s in document["per_type"].items())
        assert [c["clip_index"] for c in document["clips"]] == list(range(clip_count))
        assert all(same(c, slow([r for r in own if r[1] == c["clip_index"]])) for c in document["clips"])


def test_no_documents_and_scores_of_one_table(spark):
    counts = spark.createDataFrame([], COUNTS)
    clips = counts.select("document", "clip_index", "clip_name")
    assert nested_summary(counts, clips, ["document"], ["clip_index"]).count() == 0
    long = score_rollup(counts, clips, ["clip_index"])
    assert [r["level"] for r in long.collect()] in ([], ["overall"])
    assert long.columns[:3] == ["level", "clip_index", "type"]

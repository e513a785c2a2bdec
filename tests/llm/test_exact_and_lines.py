"""Exact deduplication and line deduplication against small models."""

import hashlib
from collections import Counter

import pytest
from llm.helpers import LOWERED, clashing, documents

from inputtrace.llm.exact_dedup import DigestIndex, deduplicate, deduplicate_batches, new_index
from inputtrace.llm.line_dedup import LineRuns, batch_counts, drop_frequent, drop_seen, line_counts
from inputtrace.session import scratch_path

TEXTS = ["a", "b", "a", None, "", "a ", "é" * 50_000, "é" * 50_000, "A", "b"]


def test_last_copy_stays(spark):
    docs = clashing(documents(spark, TEXTS))
    rows = deduplicate(docs, new_index(docs), carry=docs.columns).collect()
    assert len(rows) == len(TEXTS)
    groups = {}
    for i, text in enumerate(TEXTS):
        groups.setdefault(text or "", []).append(i)
    for row in rows:
        group = groups[row["text"] or ""]
        assert (row["keep_id"], row["group_size"]) == (max(group), len(group))
    kept = [r["doc_id"] for r in rows if r[len(docs.columns) + 2]]
    assert sorted(kept) == sorted(max(g) for g in groups.values())


def test_repeated_rows_and_null_ids(spark):
    docs = documents(spark, ["x", "x", "y", "y", "x"], [1, 1, None, None, None])
    rows = deduplicate(docs, new_index(docs), carry=["doc_id", "text"]).collect()
    kept = [(r["doc_id"], r["text"]) for r in rows if r["kept"]]
    assert sorted(kept, key=str) == [(1, "x"), (None, "y")]


def test_index_carries_over(spark):
    path = scratch_path(spark, "index")
    first = documents(spark, ["a", "b", "a"])
    deduplicate(first, DigestIndex(spark, path, buckets=4)).collect()
    spark.sql("drop table if exists " + DigestIndex(spark, path, buckets=4).seen.name)  # as in a new session
    again = DigestIndex(spark, path, buckets=4)
    rows = {r["doc_id"]: r for r in deduplicate(documents(spark, ["b", "c"], [7, 8]), again, carry=["doc_id"]).collect()}
    assert (rows[7]["keep_id"], rows[7]["kept"], rows[8]["keep_id"], rows[8]["kept"]) == (1, False, 8, True)
    assert again.seen.read().count() == 3
    plan = again.seen.read().join(again.seen.read().hint("merge"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


@pytest.mark.parametrize("batches", [1, 3, 4])
def test_batches_meet_the_index(spark, batches):
    """Batches give what one gives, and later ones find the digests of earlier ones in the index."""
    texts = TEXTS * 3 + ["only first", "last"] + ["x"] * 3
    ids = [i * 7 % 30 for i in range(30)] + [-5, 99, None, None, None]
    docs = clashing(documents(spark, texts, ids))
    whole = deduplicate(docs, new_index(docs), carry=["doc_id", "text"])
    index = new_index(docs)
    parts = deduplicate_batches(docs, index, batches, carry=["doc_id", "text"])
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    assert index.seen.read().count() == len({t or "" for t in texts})
    again = deduplicate_batches(docs, index, batches, carry=["doc_id"]).collect()
    assert len(again) == len(texts) and not any(r["kept"] for r in again)


def test_no_rows(spark):
    docs = documents(spark, [])
    assert deduplicate_batches(docs, new_index(docs), 3).count() == 0
    assert drop_frequent(docs, LineRuns(spark, scratch_path(spark, "runs")), batches=3).count() == 0
    assert deduplicate(docs, new_index(docs)).count() == 0
    assert drop_frequent(docs, LineRuns(spark, scratch_path(spark, "runs"))).count() == 0


def model(texts, least):
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(LOWERED)

    lines = [(t or "").split("\n") for t in texts]
    often = Counter(k for own in lines for k in {key(line) for line in own} if k)
    for own in lines:
        kept = [line for line in own if not key(line) or often[key(line)] < least]
        yield len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


@pytest.mark.parametrize("batches", [1, 5])
def test_frequent_lines(spark, batches):
    texts = ["Head\nx\n\nfoot ", "head\ny\n\nFOOT", " HEAD\t\nz", None, "", "É\né", "\n\n", "head", "x" * 100_000 + "\nhead", "Foot\nfoot"]
    docs = clashing(documents(spark, texts))
    found = drop_frequent(docs, LineRuns(spark, scratch_path(spark, "runs")), 3, carry=["doc_id"], batches=batches)
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])
    got = [(r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in rows]
    assert got == list(model(texts, 3))


def test_batches_go_through_two_levels(spark):
    """Five batches: four are compacted, the fifth is anti-joined with them and stays beside them."""
    path = scratch_path(spark, "many-lines")
    texts = [f"often\nline {i % 60}\nonly {i}" for i in range(500)]
    documents(spark, texts).write.parquet(path)
    docs, runs = spark.read.parquet(path), LineRuns(spark, scratch_path(spark, "runs"), buckets=3)
    rows = drop_frequent(docs, runs, 9, carry=["doc_id"], batches=5).collect()
    assert [len(level) for level in runs.levels] == [1, 1]
    found = {r["doc_id"]: r["kept_text"] for r in rows}
    assert found == {i: f"only {i}" if i % 60 < 20 else f"line {i % 60}\nonly {i}" for i in range(500)}
    # Each batch holds the line, but once a run shows it to be frequent, later ones leave it out.
    assert sum(batch.where("n > 50").count() for batch in batch_counts(docs, 5)) == 5
    assert runs.counts().agg({"n": "max"}).first()[0] < 500
    plan = runs.unseen(batch_counts(docs, 5)[0], 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "LeftAnti" in plan and plan.count("Exchange") == 1


def test_levels_and_reopening(spark):
    path, whole = scratch_path(spark, "runs"), Counter()
    for batch in range(7):
        texts = [f"line {i}\ncommon\nbatch {batch}" for i in range(batch, batch + 3)]
        runs = LineRuns(spark, path, fanout=2, buckets=3)
        runs.add(line_counts(documents(spark, texts)))
        for r in line_counts(documents(spark, texts)).collect():
            whole[(r["h1"], r["h2"])] += r["n"]
    runs = LineRuns(spark, path)
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    assert {(r["h1"], r["h2"]): r["n"] for r in runs.counts().collect()} == dict(whole)


def test_seen_lines_go(spark):
    runs = LineRuns(spark, scratch_path(spark, "runs"), buckets=3)
    assert [r["kept_text"] for r in drop_seen(documents(spark, ["a\nb\na"]), runs).collect()] == ["a\nb\na"]
    rows = drop_seen(documents(spark, ["c\nB\n", "a", None]), runs, carry=["doc_id"]).collect()
    assert {r["doc_id"]: r["kept_text"] for r in rows} == {0: "c\n", 1: "", 2: ""}


@pytest.mark.parametrize("least", [1, 2])
def test_every_line_dropped(spark, least):
    texts = ["a\na", "a"]
    rows = drop_frequent(documents(spark, texts), LineRuns(spark, scratch_path(spark, "runs")), least, carry=["doc_id"])
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in rows.collect()) == [(0, 2, 2, ""), (1, 1, 1, "")]


def test_row_numbers_hold_when_cores_change(spark):
    from inputtrace.llm.common import numbered, scratch_path

    path, cores = scratch_path(spark, "many-files"), "spark.sql.leafNodeDefaultParallelism"
    kept = {name: spark.conf.get(name) for name in ("spark.sql.files.openCostInBytes",)}
    spark.range(4000).selectExpr("id", "cast(id as string) as text").repartition(16).write.parquet(path)
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        seen = []
        for n in ("2", "16"):
            spark.conf.set(cores, n)
            rows = numbered(spark.read.parquet(path), "text", ["id"])
            seen.append({r["doc"]["id"]: r["row"] for r in rows.collect()})
    finally:
        spark.conf.unset(cores)
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 4000

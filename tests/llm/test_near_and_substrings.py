"""SimHash groups and substring deduplication against brute force."""

import random

import numpy as np
import xxhash
from llm.helpers import LOWERED, WORD, clashing, documents, sentences

from inputtrace.llm.simhash import components, connect, fingerprint, group_near, near_pairs, references
from inputtrace.llm.substring import remove_repeats


def slow_fingerprint(text, words):
    found = WORD.findall((text or "").translate(LOWERED))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def slow_groups(ids, prints, distance):
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [min(ids[j] for j in range(len(ids)) if group[j] == group[i]) for i in range(len(ids))]


def edited(text, n, rng):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(["zz", "yy", "Xx"])
    return " ".join(words)


def near_texts():
    rng = random.Random(3)
    texts = sentences(40, 1, 120)
    for base in range(6):
        texts += [edited(texts[base], rng.randint(0, 4), rng) for _ in range(12)]
    texts += [None, "", " \n", "one", "One", "two words", "x " * 30_000, texts[0], texts[0].upper()]
    return texts


def test_groups(spark):
    texts = near_texts()
    docs = clashing(documents(spark, texts))
    rows = sorted(group_near(docs, 4, 4, 6, 2, 1, carry=docs.columns).collect(), key=lambda r: r["doc_id"])
    prints = [slow_fingerprint(t, 4) for t in texts]
    place = len(docs.columns)
    assert [r[place] % (1 << 64) for r in rows] == prints
    want = slow_groups(list(range(len(texts))), prints, 4)
    assert [r["component_id"] for r in rows] == want
    assert sorted(r["doc_id"] for r in rows if r["first"]) == sorted(set(want))


def test_repeated_rows_and_nulls(spark):
    docs = documents(spark, ["same words here", "same words here", "same words here", None], [5, 5, None, None])
    rows = group_near(docs, carry=["doc_id"]).collect()
    assert sorted((r["component_id"] or -1, r["first"]) for r in rows) == [(-1, True), (5, False), (5, False), (5, True)]
    assert group_near(documents(spark, [])).count() == 0


def test_recall_beyond_the_blocks(spark):
    rng = random.Random(9)
    texts = [t for base in sentences(150, 5, 150) for t in (base, edited(base, rng.randint(1, 6), rng))]
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r["component_id"] for r in group_near(docs, carry=["doc_id"]).collect()}
    prints = [slow_fingerprint(t, 5) for t in texts]
    near = [i for i in range(0, len(texts), 2) if bin(prints[i] ^ prints[i + 1]).count("1") <= 8]
    assert len(near) > 60
    assert sum(rows[i] == rows[i + 1] for i in near) >= 0.9 * len(near)


def shingle_set(text, words=5):
    found = WORD.findall((text or "").translate(LOWERED))
    return {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def similar_groups(texts, least=0.8):
    sets, group = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            union = len(sets[i]) + len(sets[j]) - shared
            if group[i] != group[j] and (not union or shared / union >= least):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [group.index(g) for g in group]


def related_texts():
    """Pairs about the similarity of 0.8 on both sides, chains, and texts with a common passage."""
    rng = random.Random(5)
    texts = [t for base in sentences(60, 5, 150) for t in (base, edited(base, rng.randint(1, 6), rng))]
    chain = sentences(1, 6, 200)[0].split()
    texts += [" ".join(chain[i * 10 : i * 10 + 120]) for i in range(8)]
    passage = sentences(1, 7, 60)[0]
    texts += [f"{passage} {t}" for n in (4, 10, 40) for t in sentences(30, 8 + n, n)]
    return texts + near_texts()


def test_links_are_verified(spark):
    texts = related_texts()
    rows = group_near(documents(spark, texts), 5, 8, 8, 3, 3, carry=["doc_id"], similarity=0.8).collect()
    got, want = {r["doc_id"]: r["component_id"] for r in rows}, similar_groups(texts)
    assert all(want[i] == want[got[i]] for i in range(len(texts)))
    by_bits = slow_groups(list(range(len(texts))), [slow_fingerprint(t, 5) for t in texts], 8)
    assert any(want[i] != want[by_bits[i]] for i in range(len(texts)))  # bits alone link others


def test_all_similar_pairs_and_no_others(spark):
    texts = related_texts()
    rows = group_near(clashing(documents(spark, texts)), 5, 8, 8, 3, 3, carry=["doc_id"], similarity=0.8).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    want = similar_groups(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sorted(r["doc_id"] for r in rows if r["first"]) == sorted(set(want))
    by_bits = slow_groups(list(range(len(texts))), [slow_fingerprint(t, 5) for t in texts], 8)
    assert any(w != b for w, b in zip(want, by_bits))  # links by bits alone are others


def test_pipeline_near_copies(spark):
    from corpus_pipeline import simhash_near_dedup

    texts = related_texts()
    rows = simhash_near_dedup(spark, documents(spark, texts), "").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(set(similar_groups(texts)))


def test_similarity_of_no_rows(spark):
    assert group_near(documents(spark, []), similarity=0.8).count() == 0


def test_cells_compare_what_they_must():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fp = np.array([c ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for c in centre for a, b in rng.integers(0, 63, (150, 2))])
    run = np.repeat([1, 2, 3], 150)
    side, same = rng.integers(0, 2, 450), np.repeat([True, False, True], 150)
    a, b = near_pairs(fp, run, side, same, 3, references())
    got = {(int(min(x, y)), int(max(x, y))) for x, y in zip(a, b)}
    want = {
        (i, j) for i in range(450) for j in range(i + 1, 450)
        if run[i] == run[j] and (same[i] or side[i] != side[j]) and bin(int(fp[i] ^ fp[j])).count("1") <= 3
    }
    assert got == want


def test_components():
    rng = random.Random(4)
    a, b = ([rng.randrange(200) for _ in range(150)] for _ in range(2))
    label = components(200, np.array(a), np.array(b))
    assert all(label[x] == label[y] for x, y in zip(a, b)) and (label <= np.arange(200)).all()
    assert fingerprint("", 4) == 0


def test_long_chain(spark):
    rng = random.Random(2)
    names = [rng.randrange(1 << 60) for _ in range(3000)]
    roots = connect(spark.createDataFrame(list(zip(names, names[1:])), "a bigint, b bigint"))
    rows = roots.collect()
    assert len(rows) == 3000 and len({r["root"] for r in rows}) == 1


def slow_removal(texts, ids, length=20):
    seen, out = {}, {}
    words = [WORD.findall(t or "") for t in texts]
    for d in sorted(range(len(texts)), key=lambda d: (ids[d] is not None, ids[d] or 0)):
        gone = set()
        for i in range(len(words[d]) - length + 1):
            if seen.setdefault(tuple(words[d][i : i + length]), (d, i)) != (d, i):
                gone.update(range(i, i + length))
        out[d] = (len(words[d]), len(gone), " ".join(w for i, w in enumerate(words[d]) if i not in gone))
    return [out[d] for d in range(len(texts))]


def repeat_texts():
    rng = random.Random(7)
    texts = sentences(30, 2, 90, 60)
    shared = sentences(3, 8, 35)
    for i in range(40):
        words = rng.choice(texts).split()
        start = rng.randrange(0, 60)
        part = " ".join(words[start : start + rng.randint(10, 60)])
        texts.append(f"{rng.choice(sentences(1, i, 7))}\n{part}  {rng.choice(shared)}\té {i} {rng.choice(shared)}")
    texts += [None, "", "a " * 19, "a " * 20, "a " * 21, "b c " * 40, "  ", texts[0], texts[0], " ".join(["x"] * 30), "w " * 5000]
    return texts


def test_repeats(spark):
    texts = repeat_texts()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    docs = clashing(documents(spark, texts, ids))
    rows = {r["doc_id"]: r for r in remove_repeats(docs, carry=["doc_id"]).collect()}
    for i, want in zip(ids, slow_removal(texts, ids)):
        row = rows[i]
        assert (row["n_words"], row["n_removed"], row["kept_text"]) == want
        spans = [(s["start"], s["end"]) for s in row["repeats"]]
        assert sum(e - s for s, e in spans) == row["n_removed"]
        assert all(e < s for (_, e), (s, _) in zip(spans, spans[1:]))


def test_repeats_of_rows_and_empty_tables(spark):
    text = " ".join(map(str, range(25)))
    rows = remove_repeats(documents(spark, [text] * 3, [4, 4, None]), carry=["doc_id"]).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 0), (4, 25), (4, 25)]
    assert remove_repeats(documents(spark, [])).count() == 0


def test_stored_tables_leave_no_shuffle_files(spark):
    from pyspark.sql import functions as F
    from inputtrace.llm.common import stored

    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    found = stored(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert tracker.shuffleStatuses().size() <= before
    assert sorted(r["count"] for r in found.collect()) == [142, 143, 143, 143, 143, 143, 143]


def test_shingle_sets_of_all_texts_are_not_stored(spark, monkeypatch):
    from pathlib import Path
    from urllib.parse import urlparse

    from inputtrace.llm import simhash

    texts, sizes = [*sentences(200, 12, 600), *sentences(40, 13, 60)], {}

    def stored(df, name, write=simhash.stored):
        found = write(df, name)
        sizes[name] = max(sizes.get(name, 0), sum(Path(urlparse(f).path).stat().st_size for f in found.inputFiles()))
        return found

    monkeypatch.setattr(simhash, "stored", stored)
    assert group_near(documents(spark, texts), similarity=0.8).where("first").count() == len(texts)
    assert max(sizes.values()) < 4 * sum(len(shingle_set(t)) for t in texts)  # a set has eight bytes a shingle


def test_parities_never_exceed_the_difference():
    from inputtrace.llm.simhash import folded, parities

    rng = np.random.default_rng(1)
    for n, m, shared in ((0, 0, 0), (1, 0, 0), (500, 520, 480), (700, 3000, 600), (5000, 5000, 10)):
        both = [rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (shared, n - shared, m - shared)]
        a, b = (parities(np.concatenate((both[0], both[i]))) for i in (1, 2))
        size = min(len(a), len(b))
        apart = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
        assert apart <= n + m - 2 * shared
        assert n < 5000 or apart > (n + m) / 9  # unlike sets are told apart, however large


def test_links_of_a_dense_group_stay_few(spark):
    from inputtrace.llm.simhash import links

    rng, prints = random.Random(11), set()
    for centre in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(400):
            prints.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))}))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    for distance, blocks, agree, layouts in ((8, 8, 3, 3), (4, 6, 2, 1)):
        nodes = spark.createDataFrame([(p,) for p in signed], "fp bigint")
        found = [(r["a"], r["b"]) for r in links(nodes, distance, blocks, agree, layouts).collect()]
        assert len(found) < 2 * len(signed)
        place = {p: i for i, p in enumerate(signed)}
        label = components(len(signed), *(np.array([place[r[i]] for r in found]) for i in (0, 1)))
        want = slow_groups(list(range(len(signed))), [p % (1 << 64) for p in signed], distance)
        assert label.tolist() == want


def test_links_are_connected_once(spark, monkeypatch):
    from inputtrace.llm import simhash

    rng, given = random.Random(12), []
    base, passage = sentences(1, 14, 120)[0], sentences(1, 15, 60)[0]
    texts = [edited(base, rng.randint(0, 2), rng) for _ in range(150)]
    texts += [f"{passage} {t}" for t in sentences(150, 16, 40)]

    def counted(edges, connect=simhash.connect):
        given.append({(r["a"], r["b"]) for r in edges.collect()})
        return connect(edges)

    monkeypatch.setattr(simhash, "connect", counted)
    rows = group_near(documents(spark, texts), 5, 8, 8, 3, 3, carry=["doc_id"], similarity=0.8).collect()
    got, want = {r["doc_id"]: r["component_id"] for r in rows}, similar_groups(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert len(given) > 1 and all(given[:2])
    assert len(set.union(*given)) == sum(map(len, given)) < 2 * len(texts)


def test_keys_of_fingerprints_are_not_broadcast(spark):
    from inputtrace.llm.simhash import links

    rng = random.Random(17)
    nodes = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(2000)], "fp bigint")
    found = links(nodes, 8, 8, 3, 3)  # 168 keys each, in a table that Spark takes for as small as the nodes
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_broadcasts_are_small_by_the_size_of_their_files(spark, monkeypatch):
    from inputtrace.llm import simhash
    from inputtrace.llm.common import BROADCAST, THRESHOLD

    seen, texts = [], sentences(30, 18) * 2

    def seeing(df, name, stored=simhash.stored):
        seen.append(int(spark.conf.get(THRESHOLD)))
        return stored(df, name)

    monkeypatch.setattr(simhash, "stored", seeing)
    before = spark.conf.get(THRESHOLD)
    for value, most in ((before, BROADCAST), ("1k", 1024), ("-1", -1)):
        spark.conf.set(THRESHOLD, value)
        try:
            found = group_near(documents(spark, texts), carry=["doc_id"], similarity=0.8)
            assert spark.conf.get(THRESHOLD) == value
            assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
            assert found.where("first").count() == 30
        finally:
            spark.conf.set(THRESHOLD, before)
        assert set(seen) == {most}
        seen.clear()

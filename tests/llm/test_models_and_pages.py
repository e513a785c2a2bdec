"""Language, quality, page text, leaks and the pipeline."""

import random

import pytest
from llm.helpers import clashing, documents, sentences, stored

import __spark_entry__
import corpus_pipeline
from inputtrace.llm import language_id, quality
from inputtrace.llm.decontaminate import Template, leaks
from inputtrace.llm.html_text import extract, main_text

TABLES = "/root/testdata/sf0.001"


def test_language_is_learned(spark):
    found = __spark_entry__.queries()["op8_rank_order_profiles"](spark, "/root/testdata/sf0.01")
    told = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(told, "doc_id").collect()
    assert len(rows) > 200 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_language_cases(spark):
    docs = clashing(documents(spark, ["the cat sat", None, "", "12 ! ²", "THE CAT", "猫", "a" * 200_000]))
    profiles = {"xx": language_id.grams("the cat sat on the mat")[0].tolist(), "yy": language_id.grams("la le lo")[0].tolist()}
    rows = {r["doc_id"]: r for r in language_id.predict(docs, profiles, carry=["doc_id"]).collect()}
    assert [rows[i][1] for i in range(5)] == ["xx", "und", "und", "und", "xx"]
    assert rows[5][1] in ("xx", "yy") and rows[5][2] == 0.0
    assert {r[0] for r in language_id.predict(docs, {}).collect()} == {"und"}
    assert language_id.learn(documents(spark, [None])) == {} and language_id.learn(documents(spark, [])) == {}


def test_grams_by_hand():
    values, counts = language_id.grams("Ab, a1b")
    def code(s):
        return sum(ord(c) << 21 * i for i, c in enumerate(s))
    want = {"a": 2, "b": 2, " a": 2, "ab": 1, "b ": 2, " b": 1, "a ": 1, " ab": 1, "ab ": 1, " a ": 1, " b ": 1}
    assert dict(zip(values.tolist(), counts.tolist())) == {code(k): v for k, v in want.items()}


def test_quality_is_learned(spark):
    found = __spark_entry__.queries()["op9_compression_quality"](spark, "/root/testdata/sf0.01")
    told = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.where("held_out").join(told, "doc_id").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert sum(g > b for g in good for b in bad) >= 0.9 * len(good) * len(bad)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.88 * len(rows)


def test_quality_cases(spark):
    docs = clashing(documents(spark, ["fine text", None, "", "x" * 500_000]))
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 0)], "doc_id bigint, quality int")
    assert quality.learn(docs, labels) is None
    assert {r[0] for r in quality.score(docs, None).collect()} == {0.5}
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, 0)], "doc_id bigint, quality int")
    rows = quality.score(docs, quality.learn(docs, labels), carry=["doc_id"]).collect()
    assert len(rows) == 4 and all(0 <= r[1] <= 1 for r in rows)


def test_page_text():
    page = """<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav>
      <div class="cookie-notice"><p>We use, many, many, cookies, here and there, in long words.</p></div>
      <div id="content"><header><a href=/>home</a></header><h1>Head &amp; line</h1><p>One,\n two<br>three &eacute;
      <p>Four <b>five</b>.<ul><li>six<li><a href=y>seven</a></ul><blockquote><p>eight</p></blockquote>
      <form><input value=v><button>send</button></form><div class="comments"><p>I agree, fully, with, all, of it.</p></div></div>
      <aside><p>side, side, side</p></aside><footer>foot</footer><script>var a="</p>";</script></body></html>"""
    assert main_text(page) == "Head & line\n\nOne, two three é\n\nFour five.\n\nsix\n\nseven\n\neight"
    assert [main_text(t) for t in ("", "plain", "<p>a<p>b", "<nav>x</nav>", "<p>&#65;&nbsp;b</p>")] == ["", "plain", "a\n\nb", "", "A b"]


STORY = "".join(f"<p>Sentence {i} of the story, with a comma, and some more words to read.</p>" for i in range(6))
STORY_TEXT = "\n\n".join(f"Sentence {i} of the story, with a comma, and some more words to read." for i in range(6))


@pytest.mark.parametrize("name", ["content has-sidebar", "post alert-level", "post no-comments", "page-menu-open", "content"])
def test_articles_in_containers_with_marked_names(name):
    side = '<div class="ad"><p>Buy, buy, buy.</p></div><div class="sidebar"><p>On the side, as well.</p></div>'
    remarks = '<div class="comments">' + "<p>I agree, fully, with, all, of it, and more.</p>" * 40 + "</div>"
    for story in (STORY, f"<article>{STORY}</article>", f"<main>{STORY}</main>"):
        assert main_text(f'<body>{side}<div class="{name}">{story}{side}{remarks}</div>{remarks}</body>') == STORY_TEXT


def test_marked_containers_beside_an_article():
    for name in ("ad", "ad-box", "related", "sidebar-left", "comments", "cookie notice"):
        other = f'<div class="{name}">' + "<p>Not, a, part, of, the, story.</p>" * 3 + "</div>"
        assert main_text(f"<body>{other}<article>{STORY}{other}</article>{other}</body>") == STORY_TEXT
        alone = main_text(f'<body><div class="{name}"><p>Alone, and marked.</p></div></body>')
        assert alone == ("Alone, and marked." if "-" in name else "")  # nothing else is there to read
    cards = '<div class="related">' + "<article><p>Another, story, to, read.</p></article>" * 9 + "</div>"
    assert main_text(f"<body><article>{STORY}</article>{cards}</body>") == STORY_TEXT
    assert main_text(f'<div class="notice"><article>{STORY}</article></div>') == STORY_TEXT


@pytest.mark.parametrize("part", ["section", "div"])
def test_short_parts_of_an_article_stay(part):
    page = f"<article><{part}>{STORY}</{part}><{part}><h2>End</h2><p>Short.</p></{part}></article>"
    links = "<ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul>"
    assert main_text(f"<body>{page}<p>x</p></body>") == STORY_TEXT + "\n\nEnd\n\nShort."
    assert main_text(f"<main>{page.replace('article', 'div')}{links}</main>") == STORY_TEXT + "\n\nEnd\n\nShort."


def test_pages_of_nothing_and_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "<p>a, b</p>", "u", 2), (None, None, None, None), (1, "<p>a, b</p>", "u", 2)],
                                  "text bigint, html string, doc string, n_chars int")
    rows = extract(stored(spark, pages), carry=["doc"]).collect()
    assert sorted((r["doc"] or "", r["text"], r["n_chars"]) for r in rows) == [("", "", 0), ("u", "a, b", 4), ("u", "a, b", 4)]
    assert extract(stored(spark, pages.limit(0)), carry=["doc"]).count() == 0


def test_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "<p>in, the, deep</p>" + "</div>" * 3000
    pages = spark.createDataFrame([(1, "u", None), (2, "u", deep), (2, "u", "<p>" + "word, " * 50_000)], "page_id bigint, url string, html string")
    rows = extract(stored(spark, pages), carry=["page_id"]).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in rows) == [(1, 0), (2, 13), (2, 299_999)]
    assert all(len(r["text"]) == r["n_chars"] for r in rows)


def test_pages_of_the_tables(spark):
    import html
    import re

    rows = __spark_entry__.queries()["op7_tree_scoring"](spark, TABLES).collect()
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{TABLES}/pages.parquet").collect()}
    assert len(rows) == len(source)
    for row in rows:
        inside = re.search("<article>(.*?)</article>", source[row["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inside)]
        assert row["text"] == "\n\n".join(p for p in parts if p)


ITEM = "A train leaves Dover at 9 with 40 people and 25 km later Anna and 12 friends join, how many people are aboard at 9?"


def leaked(spark, texts, items, **options):
    docs = clashing(documents(spark, texts))
    items = stored(spark, spark.createDataFrame(items, "item_id bigint, text string"))
    found = leaks(docs, items, **options).collect()
    partition = {r["row"]: r for r in found}
    del partition
    from inputtrace.llm.common import numbered

    ids = {r["row"]: r["doc"]["doc_id"] for r in numbered(docs, "text", ["doc_id"]).collect()}
    return {(ids[r["row"]], r["item"]): r["same_values"] for r in found}


def test_leaks(spark):
    noise = sentences(6, 11, 60)
    new_values = ITEM.replace("9", "7").replace("40", "55").replace("25", "31").replace("12", "4").replace("Anna", "Maria")
    broken = ITEM.replace("at 9?", "at 8?").replace("at 9 with", "at 7 with")
    texts = [
        noise[0] + "\n" + ITEM + "\n" + noise[1], noise[1] + ". " + new_values, noise[2], None, "", ITEM.upper(),
        broken.replace("A train leaves Dover at 7", "A train leaves Dover at 6"), noise[3] * 200, "2 + 2",
    ]
    found = leaked(spark, texts, [(1, ITEM), (2, None), (3, ""), (4, "what is 2 + 2"), (5, "lonely items are here too")])
    assert found[(0, 1)] is True and found[(1, 1)] is False and (5, 1) in found
    assert not {d for d, _ in found} & {2, 3, 4, 7}
    assert leaked(spark, [ITEM], []) == {} and leaked(spark, [], [(1, ITEM)]) == {}


def test_slots_must_agree(spark):
    item = "add 3 apples to 3 pears and then give 3 plums to the first of 3 boys in line"
    same = item.replace("3", "8")
    mixed = "add 1 apples to 2 pears and then give 4 plums to the first of 5 boys in line"
    assert leaked(spark, [same, mixed, item], [(1, item)]) == {(0, 1): False, (2, 1): True}


def test_leaks_of_the_tables(spark):
    rows = __spark_entry__.queries()["op1_template_decontamination"](spark, TABLES).collect()
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    items = spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in (d["text"] or "")}
    assert want <= {(r["doc_id"], r["item_id"]) for r in rows} and len(rows) <= len(want) + 2


def test_template():
    words = Template("He paid $5.50 for 3 kg to Anna.\nAnna left")
    assert [words.values(i, 1) for i in range(len(words))] == [[], [], ["5.50"], [], ["3"], ["kg"], [], ["anna"], [], []]


@pytest.fixture(scope="module")
def stages(spark):
    docs, found = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(spark, stage(spark, docs, "/root/testdata/sf0.01"))
        found[name] = (before, docs)
    return found


def test_stages_filter(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns
        assert after.exceptAll(before).count() == 0, name


def test_stage_results(spark, stages):
    before, after = stages["exact dedup"]
    assert after.count() == before.select("text").distinct().count() == after.select("text").distinct().count()
    before, after = stages["language ID"]
    assert before.count() - after.count() == before.where("text is null or not text rlike '[\\\\p{L}]'").count()
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    before, after = ([r["text"] for r in df.select("text").collect()] for df in stages["benchmark decontamination"])
    assert not [t for t in after if any(i in t for i in items)]
    clean = [t for t in before if not any(i.lower() in t.lower() for i in items)]
    assert len(set(clean) - set(after)) <= 2
    last = stages["BPE encoding and decoding"][1]
    assert last.count() == len(after) and last.where("n_tokens <> size(ids)").count() == 0


def test_near_stage_against_brute_force(spark):
    rng = random.Random(6)
    bases = sentences(30, 12, 200, 3000)
    near = [" ".join(w if i != 100 else "changed" for i, w in enumerate(b.split())) for b in bases[:10]]
    docs = documents(spark, bases + near)
    rng.shuffle(bases)
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    assert set(range(30)) <= kept and len(kept) <= 31


def test_stages_with_clashing_columns_and_nulls(spark):
    from pyspark.sql import functions as F

    texts = [*sentences(8, 21, 50), None, "", "1 2 3", None]
    docs = clashing(documents(spark, texts, [*range(11), None]))
    extra = {n: F.lit(1) for n in ("first", "lang_pred", "keep_id", "fingerprint", "whole", "n_tokens", "item", "group_size")}
    docs = stored(spark, docs.withColumns(extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, TABLES)
        assert found.columns == docs.columns, name
        assert {r["doc_id"] for r in found.collect()} >= set(range(8)), name
    assert corpus_pipeline.bpe(spark, docs, TABLES).count() == len(texts)


def test_stages_on_nothing(spark):
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, TABLES).count() == 0, name


def test_amounts_are_numbers():
    from inputtrace.llm.decontaminate import NUMERIC, WORD, read_token

    for token in ("5", "$5", "€5", "£5.50,", "(¥300)", "25kg", "12%", "1,000.5"):
        assert read_token(token)[0] == NUMERIC, token
    for token in ("€", "b5", "kg", "v2x"):
        assert read_token(token)[0] != NUMERIC, token
    assert read_token("word")[0] == WORD

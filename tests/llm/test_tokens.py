"""Encoding against the tokenizers library, and the compressed files."""

import random
import zlib

import numpy as np
import pytest
from llm.helpers import clashing, documents, sentences
from tokenizers import Tokenizer

from inputtrace.llm import bpe, repair
from inputtrace.session import scratch_path

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(1)
    letters = "ab '’s  éÉİΣσß<|startoftext|>́\x00\x1c\x85½٣中文😀#!?\n\t1\xa0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", " ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>c", "ΟΔΥΣΣΕΥΣ", "I'LL we'Ve 12.5km", "x" * 3000]
    return texts + sentences(30, 3) + [" ".join(sentences(300, 4))]


def test_encoding_is_the_library_s(spark, library):
    texts = odd_texts()
    docs = clashing(documents(spark, texts))
    name = bpe.build_lexicon(docs, PATH, size=200)
    rows = sorted(bpe.encode(docs, PATH, name, carry=["doc_id"]).collect(), key=lambda r: r["doc_id"])
    for text, row in zip(texts, rows):
        assert row[1] == library.encode(text or "", add_special_tokens=False).ids
    assert bpe.encode(documents(spark, []), PATH, name).count() == 0


def test_decoding_is_the_library_s(library):
    codec = bpe.Codec(PATH, bpe.compile_words([], []))
    texts = [t or "" for t in odd_texts()]
    for text, ids in zip(texts, codec.encode(texts)):
        assert codec.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_no_words_at_all(spark):
    docs = documents(spark, [])
    assert bpe.digests(docs, PATH, bpe.build_lexicon(docs, PATH)).count() == 0


def test_transducer():
    words = sorted({w.encode() for t in sentences(50, 6, vocabulary=400) for w in t.split()} | {b"a", b"ab", b"\xc3\xa9"})
    outputs = [[i, i * 2] if i % 3 else [] for i in range(len(words))]
    found = bpe.Transducer(bpe.compile_words(words, outputs))
    assert found.places(words).tolist() == list(range(len(words)))
    assert found.places([b"", b"zzz", words[0] + b"\xff", words[-1][:-1]]).tolist()[:3] == [-1, -1, -1]
    assert [np.frombuffer(o, "<u4").tolist() for o in found.outputs(np.arange(len(words)))] == outputs
    ends = bpe.compile_words([b"running", b"sitting"], [[1], [2]])
    assert ends[2] < 13  # the ending is shared: fewer states than letters


@pytest.mark.parametrize("vocabulary", [50, 49408, 100_000])
def test_grammar_round_trip(vocabulary):
    rng = np.random.default_rng(vocabulary)
    common = rng.integers(0, vocabulary, 30)
    texts = [common[rng.integers(0, 30, n)].astype(np.uint32) for n in rng.integers(1, 3000, 40)]
    texts += [np.full(5000, 7, np.uint32), np.array([2], np.uint32)]
    shard = repair.Shard(repair.pack([None, *range(1, len(texts))], texts, 11, vocabulary))
    whole = np.concatenate(texts)
    assert (shard.all() == whole).all() and shard.first == 11
    assert len(shard.grammar) and len(shard.symbols) < len(whole)
    assert [shard.doc_id(i) for i in range(3)] == [None, 1, 2]
    for i, text in enumerate(texts):
        assert (shard.document(i) == text).all()
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(whole) + 1, 2).tolist())
        assert (shard.range(a, b) == whole[a:b]).all()


def test_files(spark, library, monkeypatch):
    monkeypatch.setattr(repair, "SHARD", 500)
    texts = odd_texts()
    ids = list(range(len(texts)))
    random.Random(5).shuffle(ids)
    target = scratch_path(spark, "ids")
    repair.write(clashing(documents(spark, texts, ids)), PATH, target)
    rows = sorted(repair.read(spark, target).collect(), key=lambda r: r["doc_id"])
    start = 0
    for i, row in enumerate(rows):
        want = library.encode(texts[ids.index(i)] or "", add_special_tokens=False).ids + [2]
        data = np.array(want, "<u4").tobytes()
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (i, start, len(want), zlib.crc32(data))
        start += len(want)


def test_files_of_nothing_and_of_repeated_rows(spark):
    for texts, ids in (([], []), (["a b", "a b", None], [1, 1, None])):
        target = scratch_path(spark, "ids")
        repair.write(documents(spark, texts, ids), PATH, target)
        rows = sorted(repair.read(spark, target).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in rows] == sorted(ids, key=lambda i: i or 0)
        assert [r["start"] for r in rows] == [0, 1, 4][: len(rows)]


def one_by_one(word):
    """The ids of a word by the rule itself: the pair of lowest rank, the leftmost first."""
    known = bpe.vocabulary(PATH)
    line = [bpe.byte_symbols()[b] for b in word]
    line[-1:] = [line[-1] + known.suffix] if line else []
    rank = {pair: i for i, pair in enumerate(known.merges)}
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(line, line[1:])) if p in rank), default=None)
        if best is None:
            return [known.ids[s] for s in line]
        line[best[1] : best[1] + 2] = ["".join(line[best[1] : best[1] + 2])]


def test_merging_many_words_is_merging_each():
    rng = random.Random(3)
    words = [bytes(rng.choice(b"etaoinshr\xc3\xa9\xf0 \x00") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    words += [b"", b"e", b"e" * 301, b"the" * 40, b"international", b""]
    merger = bpe.Merger(PATH)
    assert [np.frombuffer(i, "<u4").tolist() for i in merger.many(words)] == [one_by_one(w) for w in words]
    assert merger.many([]) == [] and merger.many([b"", b""]) == [b"", b""]


def test_digests_are_those_of_the_library(spark, library):
    import hashlib

    texts = odd_texts()
    docs = documents(spark, texts)
    name = bpe.build_lexicon(docs, PATH, size=200)
    for row in bpe.digests(docs, PATH, name, carry=["doc_id"]).collect():
        ids = library.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        told = library.decode(ids, skip_special_tokens=False)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(told.encode()).hexdigest()


def test_long_repeats_fold():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 49_000, 700).astype(np.uint32)
    ids = np.tile(passage, 200)
    ends = np.arange(700, len(ids) + 1, 700)
    grammar, symbols, _ = repair.compress(ids, ends, 49_408)
    assert len(symbols) < 2 * len(ends) and repair.lengths(grammar, 49_408).max() > 300
    assert (repair.expand(symbols, grammar, 49_408) == ids).all()

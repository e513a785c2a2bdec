"""Token ids in files, compressed by Re-Pair grammars.

Documents are dealt by ranges of their ids, so that files in order of their partitions hold all
documents in order. Each partition cuts its documents into shards; a shard's frequent id pairs
are replaced by nonterminals, again and again, and never across a document's end. A shard is one
binary value in the written table:

    magic, then counts and the first id's place as 64-bit integers: documents, rules, symbols, ids,
    vocabulary; document ids; each document's first symbol and first id (and the ends); rules
    (left, right); their expansion lengths; symbols

Symbols take 16 bits where vocabulary and rules fit, else 32. Expansion lengths say where in the
symbols any id lies, so any range of ids is read by expanding only the symbols that cover it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inputtrace.llm.common import numbered, table
from inputtrace.llm.wordpieces import Encoder, as_symbols, chunks, vocabulary
from inputtrace.session import scratch_path

MAGIC = b"REPAIR01"
SHARD = 1 << 19  # ids after which a shard ends, with the document that reaches it
GAIN = 200  # symbols for each one that the last round replaces, at least
SLOTS = 18
LEAST = 6  # occurrences that a rule needs
MEMO = 400_000  # words that a worker remembers at least; it holds twice as many at most
CHUNK = 1 << 16  # characters looked up together, so that their words stay in the processor's cache
NO_ID = -(1 << 63)  # stands for a null document id


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (left, right), symbols, and the documents' ends in the symbols.

    In each round the pairs are counted, and every occurrence of a frequent pair that is more
    frequent than the pairs overlapping it (the left one among equals) becomes its pair's nonterminal.
    Rounds end when no pair is frequent, the symbols' width is used up, or a round replaces less
    than one symbol in `GAIN`, so repeats of any length are folded while that pays."""
    width = 16 if vocabulary_size < (1 << 16) - 4096 else 32
    kind = np.uint32 if width == 16 else np.uint64
    room = (1 << width) - vocabulary_size if width == 16 else 1 << 20
    line = ids.astype(kind)
    stop = np.zeros(len(line), bool)
    stop[ends - 1] = True
    rules = np.empty(0, kind)
    while len(line) > 1:
        keys = line[:-1] << kind(width) | line[1:]
        values = np.sort(keys[~stop[:-1]])
        first = np.flatnonzero(values[1:] != values[:-1]) + 1
        first = np.concatenate(([0], first, [len(values)])) if len(values) else np.zeros(1, np.int64)
        counts = np.diff(first)
        often = counts >= LEAST
        values, counts = values[first[:-1][often]], counts[often]
        picked = one_per_slot(values[np.argsort(-counts, kind="stable")])
        number = place_in(rules, picked)
        new = number < 0
        fits = ~new | (np.cumsum(new) <= room - len(rules))
        picked, number, new = picked[fits], number[fits], new[fits]
        number[new] = len(rules) + np.arange(int(new.sum()))
        rules = np.concatenate((rules, picked[new]))
        if not len(picked):
            break
        none = np.int32(len(picked))
        place = rank_of(keys, picked)
        place[stop[:-1]] = none
        wins = place < none
        wins[1:] &= place[1:] < place[:-1]
        wins[:-1] &= place[:-1] <= place[1:]
        at = np.flatnonzero(wins)
        if not len(at):
            break
        line[at] = (number + vocabulary_size).astype(kind)[place[at]]
        stop[at] |= stop[at + 1]
        stay = np.ones(len(line), bool)
        stay[at + 1] = False
        line, stop = line[stay], stop[stay]
        if len(at) * GAIN < len(line):
            break
    grammar = np.stack([rules >> kind(width), rules & kind((1 << width) - 1)], axis=1)
    return grammar, line, np.flatnonzero(stop) + 1


def place_in(values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where the asked values stand among distinct ones, -1 where they don't."""
    if not len(values):
        return np.full(len(asked), -1, np.int64)
    order = np.argsort(values)
    found = order[np.minimum(np.searchsorted(values, asked, sorter=order), len(values) - 1)]
    return np.where(values[found] == asked, found, -1)


def one_per_slot(values: np.ndarray) -> np.ndarray:
    """The first value of each slot; one that meets an earlier value there waits for the next round."""
    _, first = np.unique(slot(values), return_index=True)
    return values[np.sort(first)]


def slot(keys: np.ndarray) -> np.ndarray:
    """A place in a table of 2 ** SLOTS entries."""
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS)
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)


def rank_of(keys: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """The place of each key among the picked ones, which have slots of their own; their number
    where it is not picked."""
    entries = np.zeros(1 << SLOTS, np.int32)
    entries[slot(picked)] = np.arange(len(picked), dtype=np.int32)
    place = entries[slot(keys)]
    place[picked[place] != keys] = len(picked)
    return place


def lengths(grammar: np.ndarray, vocabulary_size: int) -> np.ndarray:
    """Ids that each rule expands to; a rule only names symbols of earlier rounds."""
    symbols = grammar.astype(np.int64) - vocabulary_size
    found = np.full(len(grammar), 2, np.int64)
    while len(grammar):
        longer = np.where(symbols < 0, 1, found[np.maximum(symbols, 0)]).sum(axis=1)
        if (longer == found).all():
            break
        found = longer
    return found


def expand(symbols: np.ndarray, grammar: np.ndarray, vocabulary_size: int) -> np.ndarray:
    """The ids behind symbols: all nonterminals are replaced by their pairs until none is left."""
    line = symbols.astype(np.int64)
    while True:
        rule = line >= vocabulary_size
        if not rule.any():
            return line
        first = np.cumsum(rule + 1) - 1 - rule
        own = line[rule] - vocabulary_size
        out = np.empty(len(line) + len(own), np.int64)
        out[first] = line
        out[first[rule]] = grammar[own, 0]
        out[first[rule] + 1] = grammar[own, 1]
        line = out


def pack(doc_ids: list[int | None], texts: list[np.ndarray], first: int, vocabulary_size: int) -> bytes:
    """A shard of whole documents, none of them without ids, whose first id has the place `first`."""
    ids = np.concatenate(texts)
    ends = np.cumsum([len(t) for t in texts])
    grammar, symbols, cut = compress(ids, ends, vocabulary_size)
    width = np.uint16 if vocabulary_size + len(grammar) <= 1 << 16 else np.uint32
    head = np.array([len(texts), len(grammar), len(symbols), len(ids), vocabulary_size, first], "<i8")
    names = np.array([NO_ID if i is None else i for i in doc_ids], "<i8")
    parts = [head, names, np.append(0, cut).astype("<i8"), np.append(0, ends).astype("<i8")]
    parts += [lengths(grammar, vocabulary_size).astype("<i8"), grammar.astype(width), symbols.astype(width)]
    return MAGIC + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


class Shard:
    """A shard for reading."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard")
        docs, rules, symbols, self.n_ids, self.vocabulary, self.first = np.frombuffer(data, "<i8", 6, 8).tolist()
        at = 56

        def take(kind, n):
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        self.docs, self.cuts, self.starts = take("<i8", docs), take("<i8", docs + 1), take("<i8", docs + 1)
        self.lengths = take("<i8", rules)
        width = "<u2" if self.vocabulary + rules <= 1 << 16 else "<u4"
        self.grammar, self.symbols = take(width, 2 * rules).reshape(-1, 2), take(width, symbols)
        self._places = None

    def doc_id(self, i: int) -> int | None:
        return None if self.docs[i] == NO_ID else int(self.docs[i])

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.grammar, self.vocabulary)

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, from its own symbols."""
        return expand(self.symbols[self.cuts[i] : self.cuts[i + 1]], self.grammar, self.vocabulary)

    def range(self, start: int, end: int) -> np.ndarray:
        """The shard's ids from `start` up to `end`, from the symbols that cover them."""
        if self._places is None:
            symbols = self.symbols.astype(np.int64)
            rule = symbols >= self.vocabulary
            long = np.ones(len(symbols), np.int64)
            long[rule] = self.lengths[symbols[rule] - self.vocabulary]
            self._places = np.append(0, np.cumsum(long))
        start, end = max(0, start), min(end, self.n_ids)
        if start >= end:
            return np.empty(0, np.int64)
        a = int(np.searchsorted(self._places, start, "right")) - 1
        b = int(np.searchsorted(self._places, end, "left"))
        skip = start - int(self._places[a])
        return expand(self.symbols[a:b], self.grammar, self.vocabulary)[skip : skip + end - start]


@lru_cache(1)
def library_encoder(path: str) -> Encoder:
    """The tokenizers library's model, asked once for each distinct piece of the words at hand. A
    worker keeps it, so that words are remembered from task to task."""
    known = vocabulary(path)
    tokenize = known.tokenizer.model.tokenize

    packed = [i.to_bytes(4, "little") for i in range(known.size)]

    def asked(piece: str) -> bytes:
        return b"".join([packed[t.id] for t in tokenize(as_symbols(piece))])

    class Ids(dict):
        def __missing__(self, piece: str) -> bytes:
            found = self[piece] = encoder.memo.get(piece) or asked(piece)
            return found

    def resolve(words: list[str]) -> list[bytes]:
        whole = [w for w in words if w.isalpha()]
        ids = Ids(zip(whole, map(asked, whole)))
        return [ids[w] if w in ids else b"".join([ids[p] for p in known.pieces(w)]) for w in words]

    encoder = Encoder(known, resolve, MEMO)
    return encoder


def write(docs: DataFrame, path: str, target: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts, end each with `end_id`, and write shards (part, n_ids, data) to `target`,
    in ascending order of ids.

    Null text is the empty text and has the end id alone. Null ids come first; rows with one id
    are ordered by their text's hash. No rows write an empty table. A shard holds whole
    documents, so one that is longer than a shard makes a longer shard."""
    rows = numbered(docs, text, [doc_id]).select(
        F.col("doc").getField(doc_id).cast("long").alias("id"), F.xxhash64("text").alias("tie"), "text"
    )
    dealt = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), library_encoder(path)
        size, end = encoder.known.size, end_id.to_bytes(4, "little")
        names: list = []
        held: list[np.ndarray] = []
        n = first = 0

        def out():
            data = pack(names, held, first, size)
            arrays = [pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["part", "n_ids", "data"])

        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for texts in chunks((t.as_py() for t in batch.column(2)), CHUNK):
                for found in encoder.encode(texts, end):
                    names.append(next(ids))
                    held.append(found)
                    n += len(found)
                    if n >= SHARD:
                        yield out()
                        names, held, first, n = [], [], first + n, 0
        if held:
            yield out()

    dealt.mapInArrow(run, "part int, n_ids bigint, data binary").write.parquet(target)


def read(spark: SparkSession, target: str) -> DataFrame:
    """Per document of the written files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32. Only one number per file reaches the driver, to place the files one after another."""
    shards = spark.read.schema("part int, n_ids bigint, data binary").parquet(target)
    sizes = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_py())
                raw, starts = shard.all().astype("<u4").tobytes(), shard.starts.tolist()
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, starts[1:])]
                arrays = [
                    pa.array([shard.doc_id(i) for i in range(len(shard.docs))], pa.int64()),
                    pa.array(shard.starts[:-1] + (shard.first + before[part])),
                    pa.array(np.diff(shard.starts)),
                    pa.array(sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "data").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op2_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    target = scratch_path(spark, "repair-ids")
    write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), target)
    return read(spark, target)

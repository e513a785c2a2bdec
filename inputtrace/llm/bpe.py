"""BPE encoding and decoding with a lexicon of frequent words.

The words of all documents are counted; the most frequent ones are compiled, with their ids, into
a minimal acyclic transducer: words share their beginnings and their ends, and the numbers on a
word's path add up to its place in the list of outputs. The arrays are one file, which Spark
hands to every executor and workers map into memory. Words it lacks are merged by rank.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inputtrace.llm.common import carried, mapped, numbered, stored, table
from inputtrace.llm.wordpieces import Encoder, byte_symbols, chunks, vocabulary
from inputtrace.session import scratch_path

LEXICON = 1 << 16  # words compiled
NEVER = 1 << 22  # above any rank
PLACE = (1 << 40) - 1
HELD = 200_000  # distinct words a counting task holds before it hands counts on


class Merger:
    """Exact merging: in each word the pair of lowest rank first, the leftmost among equals."""

    def __init__(self, path: str):
        known = vocabulary(path)
        ids, symbols = known.ids, byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + known.suffix] for s in symbols], np.int64)
        pairs = np.array([(ids[a] << 32 | ids[b], ids[a + b]) for a, b in known.merges], np.int64).reshape(-1, 2)
        order = np.argsort(pairs[:, 0])
        self.pairs, self.rank, self.merged = pairs[order, 0], order, pairs[:, 1]

    def ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Ranks of pairs, `NEVER` for those that do not merge."""
        pair = first << 32 | second
        place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[place] == pair, self.rank[place], NEVER)

    def many(self, words: Sequence[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers. All words merge one pair a round; a
        word in which nothing merges is set aside."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        found = [b""] * len(words)
        word = np.flatnonzero(sizes)
        sizes = sizes[word]
        starts = np.cumsum(sizes) - sizes
        letters = np.frombuffer(b"".join(words), np.uint8)
        line = self.inner[letters]
        ends = starts + sizes - 1
        line[ends] = self.last[letters[ends]]
        rank = np.full(len(line), NEVER)
        rank[:-1] = self.ranks(line[:-1], line[1:])
        rank[ends] = NEVER
        while len(word):
            best = np.minimum.reduceat(rank << 40 | np.arange(len(line)), starts)
            live = best >> 40 < NEVER
            if not live.all():
                done = np.flatnonzero(~live)
                data = line.astype("<u4").tobytes()
                for i, a, n in zip(word[done].tolist(), starts[done].tolist(), sizes[done].tolist()):
                    found[i] = data[4 * a : 4 * (a + n)]
                stay = np.repeat(live, sizes)
                moved = starts - np.cumsum(np.where(live, 0, sizes))
                line, rank = line[stay], rank[stay]
                place = (best & PLACE)[live] - starts[live]
                word, sizes, best, starts = word[live], sizes[live], best[live], moved[live]
                place += starts
            else:
                place = best & PLACE
            line[place] = self.merged[best >> 40]
            stay = np.ones(len(line), bool)
            stay[place + 1] = False
            line, rank = line[stay], rank[stay]
            gone = np.arange(len(word))
            place, starts, sizes = place - gone, starts - gone, sizes - 1
            before = place[place > starts]
            rank[before - 1] = self.ranks(line[before - 1], line[before])
            inside = place < starts + sizes - 1
            rank[place[~inside]] = NEVER
            place = place[inside]
            rank[place] = self.ranks(line[place], line[place + 1])
        return found


@lru_cache(1)
def merger(path: str) -> Merger:
    return Merger(path)


def compile_words(words: Sequence[bytes], outputs: Sequence[Sequence[int]]) -> np.ndarray:
    """The transducer of distinct, sorted, non-empty words as one array of 64-bit integers:
    counts, then edges (state and byte, sorted), their targets, their numbers, final flags,
    output offsets, output ids.

    Words are added in order; what the next word does not share is replaced by an equal part that
    is already there, so only the last word's path is ever open."""
    register: dict[tuple, int] = {}
    closed: list[tuple] = []  # (final, ((byte, target), ...)) by state
    below: list[int] = []  # words below a closed state

    def close(final: bool, edges: list) -> int:
        key = (final, tuple(edges))
        state = register.get(key)
        if state is None:
            state = register[key] = len(closed)
            closed.append(key)
            below.append(final + sum(below[t] for _, t in edges))
        return state

    path: list[list] = [[False, []]]  # open states: final, edges to closed states
    last = b""
    for word in words:
        same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        while len(path) > same + 1:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], close(*done)))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((last[len(path) - 1], close(*done)))
    root = close(*path[0])
    edges, targets, numbers = [], [], []
    for state, (final, out) in enumerate(closed):
        before = int(final)
        for byte, target in out:
            edges.append(state << 8 | byte)
            targets.append(target)
            numbers.append(before)
            before += below[target]
    flat = [i for ids in outputs for i in ids]
    offsets = np.concatenate(([0], np.cumsum([len(ids) for ids in outputs], dtype=np.int64)))
    finals = [final for final, _ in closed]
    head = [root, len(edges), len(finals), len(offsets), len(flat)]
    return np.concatenate([np.array(x, np.int64) for x in (head, edges, targets, numbers, finals, offsets, flat)])


class Transducer:
    """Looks up many words at once, byte by byte."""

    def __init__(self, data: np.ndarray):
        self.root = int(data[0])
        sizes = [int(data[1])] * 3 + [int(x) for x in data[2:5]]
        cuts = np.cumsum([5, *sizes])
        self.edges, self.targets, self.numbers, self.finals, self.offsets, self.flat = (
            data[a:b] for a, b in zip(cuts, cuts[1:])
        )
        self.bytes = None

    def places(self, words: Sequence[bytes]) -> np.ndarray:
        """The place of each word in the outputs, -1 where it is not in the lexicon."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(words) else lengths
        letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        state = np.full(len(words), self.root, np.int64)
        total = np.zeros(len(words), np.int64)
        if not len(self.edges):
            return np.full(len(words), -1, np.int64)
        alive = np.flatnonzero(lengths > 0)
        state[lengths == 0] = -1
        depth = 0
        while len(alive):
            want = state[alive] << 8 | letters[starts[alive] + depth]
            edge = np.minimum(np.searchsorted(self.edges, want), len(self.edges) - 1)
            hit = self.edges[edge] == want
            state[alive[~hit]] = -1
            alive, edge = alive[hit], edge[hit]
            total[alive] += self.numbers[edge]
            state[alive] = self.targets[edge]
            depth += 1
            alive = alive[lengths[alive] > depth]
        found = (state >= 0) & (self.finals[np.maximum(state, 0)] == 1)
        return np.where(found, total, -1)

    def outputs(self, places: np.ndarray) -> list[bytes]:
        """The ids of the words at these places, as little-endian 32-bit integers."""
        if self.bytes is None:
            self.bytes = self.flat.astype("<u4").tobytes()
        bounds = zip((self.offsets[places] * 4).tolist(), (self.offsets[places + 1] * 4).tolist())
        return [self.bytes[a:b] for a, b in bounds]


class Codec:
    """Encoder of a worker: memory-mapped lexicon, exact merging for the rest."""

    def __init__(self, path: str, lexicon: np.ndarray):
        self.known, self.words, self.merge = vocabulary(path), Transducer(lexicon), merger(path)
        self.encoder = Encoder(self.known, self.resolve)
        self.names = [name.encode() for name in self.known.names()]
        self.numbers = [b"%d" % i for i in range(self.known.size)]
        self.teller = Encoder(self.known, self.tell)

    def resolve(self, words: list[str]) -> list[bytes]:
        split = [self.known.pieces(w) for w in words]
        distinct = {p: None for pieces in split for p in pieces}
        pieces = [p.encode() for p in distinct]
        places = self.words.places(pieces)
        known = iter(self.words.outputs(places[places >= 0]))
        merged = iter(self.merge.many([p for p, place in zip(pieces, places.tolist()) if place < 0]))
        for piece, place in zip(distinct, places.tolist()):
            distinct[piece] = next(known) if place >= 0 else next(merged)
        return [distinct[p[0]] if len(p) == 1 else b"".join(map(distinct.__getitem__, p)) for p in split]

    def tell(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each word the decimal ids and the tokens' strings, each joined by blanks."""
        found = self.resolve(words)
        flat = np.frombuffer(b"".join(found), "<u4").tolist()
        numbers, names = list(map(self.numbers.__getitem__, flat)), list(map(self.names.__getitem__, flat))
        told, at = [], 0
        for ids in found:
            end = at + len(ids) // 4
            told.append((numbers[at], names[at]) if end == at + 1 else (b" ".join(numbers[at:end]), b" ".join(names[at:end])))
            at = end
        return told

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encoder.encode(texts)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings between blanks, as the library joins them without a decoder."""
        return b" ".join(map(self.names.__getitem__, ids.tolist())).decode()

    def told(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Of each text the decimal ids and the decoded text."""
        special = {name: (b"%d" % i, name.encode()) for name, i in self.known.special.items()}
        for words in self.teller.values(texts, special):
            words = [w for w in words if w[0]]
            yield b" ".join([w[0] for w in words]), b" ".join([w[1] for w in words])


@lru_cache(1)
def codec(path: str, file: str) -> Codec:
    return Codec(path, np.memmap(SparkFiles.get(file), np.int64, "r"))


def count_words(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Pieces of all texts and how often they occur (piece, n). Tasks hand on counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = vocabulary(path), Counter()

        def out():
            pieces: Counter = Counter()
            for word, n in held.items():
                for piece in known.pieces(word):
                    pieces[piece] += n
            names = pa.array(list(pieces), pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(pieces.values(), pa.int64())], ["piece", "n"])

        for batch in batches:
            for value in batch.column(0):
                for part in known.parts(value.as_py())[::2]:
                    held.update(known.words(part))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    found = numbered(docs, text, []).select("text").mapInArrow(run, "piece string, n bigint")
    return found.groupBy("piece").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, size: int) -> list[str]:
    """The most frequent pieces: all that occur at least so often that no more than `size` do."""
    counts = stored(counts, "piece-counts")
    often = counts.groupBy("n").agg(F.count("*").alias("pieces")).toPandas().sort_values("n", ascending=False)
    fits = often["n"][often["pieces"].cumsum() <= size]
    if not len(fits):
        return []
    return [r["piece"] for r in counts.where(F.col("n") >= int(fits.min())).select("piece").collect()]


def build_lexicon(docs: DataFrame, path: str, text: str = "text", size: int = LEXICON) -> str:
    """Compile the lexicon of the documents and hand it to the executors; the file's name.

    At most `size` words reach the driver. The file is kept in the shared folder."""
    spark = docs.sparkSession
    words = sorted(w.encode() for w in frequent(count_words(docs, path, text), size))
    data = compile_words(words, [np.frombuffer(ids, "<u4").tolist() for ids in merger(path).many(words)]).astype("<i8").tobytes()
    place = scratch_path(spark, "lexicon")
    target = spark._jvm.org.apache.hadoop.fs.Path(place)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    for start in range(0, len(data), 1 << 20):
        out.write(bytearray(data[start : start + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(place)
    return place.rsplit("/", 1)[1]


def encode(
    docs: DataFrame, path: str, lexicon: str, text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """Columns ids (array<int>) and those of `carry`, one row per input row, as the tokenizers
    library encodes without added tokens. Null text is the empty text and has no ids. Special
    tokens' strings in a text become their ids, as in the library. Whole texts; repeated rows are
    alike; no rows give no rows."""
    rows = numbered(docs, text, carry).select("text", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = codec(path, lexicon)
        for batch in batches:
            at = 0
            for texts in chunks(t.as_py() for t in batch.column(0)):
                ids = worker.encode(texts)
                lists = pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(texts)), lists], ["doc", "ids"])
                at += len(texts)

    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, ids array<int>"
    return mapped(rows, run, schema).select(*carried(carry), "ids")


def digests(
    docs: DataFrame, path: str, lexicon: str, text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """Columns n_tokens, ids_sha256, decoded_sha256 and those of `carry`: the ids of each text and
    the text decoded from them, without keeping either. Cases as in `encode`."""
    rows = numbered(docs, text, carry).select("text", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = codec(path, lexicon)
        for batch in batches:
            counts, first, second = [], [], []
            for texts in chunks(t.as_py() for t in batch.column(0)):
                for ids, decoded in worker.told(texts):
                    counts.append(ids.count(b" ") + 1 if ids else 0)
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(hashlib.sha256(decoded).hexdigest())
            arrays = [batch.column(1), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return mapped(rows, run, schema).select(*carried(carry), "n_tokens", "ids_sha256", "decoded_sha256")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), default_path()
    return digests(docs, path, build_lexicon(docs, path), carry=["doc_id"])

"""Near-duplicates by SimHash, with pivot distance tables.

Every text is reduced to 64 bits. Only distinct fingerprints are compared. Two that differ in at
most r bits agree on at least a of r + a blocks of bits, so each fingerprint goes to one bucket
per choice of a blocks. In a bucket, a table of distances to many reference fingerprints
discards pairs: distances to any reference differ by no more than the pair's own distance. The
survivors are verified.

No bucket is one group: it is dealt into cells of bounded size, and a cell hands on a spanning
forest of its links, never its pairs. Components are found by contraction over written tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inputtrace.llm.common import LOWER, UPPER, WORD, bucket_count, carried, discarded, mapped, numbered, slices, small_broadcasts, stored, table
from inputtrace.llm.substring import Line

PIVOTS = 32  # reference fingerprints
THIN = 2  # times that links are moved to hubs; on which no result depends
CELL = 2048  # fingerprints of a bucket that meet those of another part of it in one cell
SEED = 42
BITS = 26  # of the tables that spare shuffles; fixed, whatever the input
SAMPLE = 8  # one of so many texts counts for the order of shingles, on which no result depends
PART = 256  # texts whose shingles a task holds at once
PARITY = 8  # 64-bit integers of a set's parities
NAMES = ["key", "node", "n", *[f"p{i}" for i in range(PARITY)]]
_LOWERED = str.maketrans(UPPER, LOWER)


def shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, in order; a text of fewer words is one, one without words has none."""
    found = WORD.findall(text.translate(_LOWERED) if not text.islower() else text)
    if not found:
        return np.empty(0, "<u8")
    line = " ".join(found).encode("utf-8", "surrogatepass")
    hash_of = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([hash_of(line, seed)], "<u8")
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()][: len(found) - words + 1]
    ends = [*gaps.tolist(), len(line)][words - 1 :]
    return np.array([hash_of(line[a:b], seed) for a, b in zip(starts, ends)], "<u8")


def shingle_values(text: str, words: int) -> np.ndarray:
    """A 64-bit hash of each shingle, in order, from cumulative sums of word hashes; as many as
    `shingle_hashes` gives, but not those hashes."""
    line = Line(text.translate(_LOWERED) if not text.islower() else text)
    if not len(line):
        return np.empty(0, np.uint64)
    line.hash_words()
    first = np.arange(max(len(line) - words + 1, 1))
    return line.stretch(first, np.minimum(first + words, len(line)))


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: str, words: int, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 hashes; 0 without words."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int, text: str, carry: Sequence[str]) -> DataFrame:
    """Rows (row, doc, fp), the fingerprint as a signed 64-bit integer. Null text is empty."""
    rows = numbered(docs, text, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            arrays = [batch.column(0), batch.column(2), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc", "fp"])

    return mapped(rows, run, f"row bigint, doc {rows.schema['doc'].dataType.simpleString()}, fp bigint")


def references(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(n)], np.uint64)


def masks(blocks: int, agree: int, layouts: int = 1) -> list[int]:
    """The bits of each choice of `agree` of `blocks` blocks, as signed integers; further layouts
    have their blocks shifted by a part of a block."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    found = []
    for layout in range(layouts):
        shift = 64 * layout // (blocks * layouts)
        for chosen in combinations(range(blocks), agree):
            whole = sum(1 << (bit + shift) % 64 for b in chosen for bit in range(cuts[b], cuts[b + 1]))
            found.append(whole - (1 << 64) if whole >> 63 else whole)
    return found


def bucketed(nodes: DataFrame, blocks: int, agree: int, layouts: int) -> DataFrame:
    """(fp, key): one key per choice of blocks, from the bits there and the choice. The small table
    is dealt out first, since each of its rows becomes many."""
    dealt = nodes.repartition(bucket_count(nodes.sparkSession), "fp")
    chosen = dealt.select("fp", F.explode(F.array(*map(F.lit, masks(blocks, agree, layouts)))).alias("mask"))
    return chosen.select("fp", F.xxhash64(F.col("fp").bitwiseAND(F.col("mask")), "mask").alias("key"))


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number linked with each of n numbers by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return label
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]


def near_pairs(
    fp: np.ndarray, run: np.ndarray, side: np.ndarray, same: np.ndarray, distance: int, pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows. Rows of one run are consecutive; where `same` is false, only rows of different
    sides are compared."""
    table_of = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    sizes = np.diff(np.append(starts, len(run)))
    left, right = [], []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        """Of the pairs (a, b): discard by the largest difference of coordinates, verify the rest."""
        fits = same[a] | (side[a] != side[b])
        a, b = a[fits], b[fits]
        for some in (slice(0, 4), slice(4, None)):
            close = (np.abs(table_of[a, some] - table_of[b, some]) <= distance).all(axis=1)
            a, b = a[close], b[close]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        left.append(a[near])
        right.append(b[near])

    small = np.repeat(sizes <= 64, sizes)
    ends = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(small)
    step = 1
    while len(at):
        at = at[at + step < ends[at]]
        keep(at, at + step)
        step += 1
    for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        rows = np.arange(start, start + size)
        for first in range(0, size, 64):
            some = rows[first : first + 64]
            close = np.ones((len(some), size), bool)
            for p in range(4):
                column = table_of[rows, p]
                close &= np.abs(column[first : first + 64, None] - column[None, :]) <= distance
            a, b = np.nonzero(close)
            a, b = some[a], rows[b]
            keep(a[a < b], b[a < b])
    return np.concatenate(left or [np.empty(0, int)]), np.concatenate(right or [np.empty(0, int)])


def thinned(edges: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that connect the same nodes as the links given, in most cases far fewer: of
    the links from b to smaller nodes the first stays, and the others join it to those nodes instead.
    Nodes of a dense group have the same few smaller ones, so these links are equal for most b. A node's
    links to smaller ones meet in one window: of fingerprints at most one a cell."""
    first = F.min("a").over(Window.partitionBy("b"))
    moved = edges.select(first.alias("first"), "a", "b")
    ends = F.when(F.col("first") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    return moved.select(F.col("first").alias("a"), ends.alias("b")).distinct()


def links(nodes: DataFrame, distance: int, blocks: int, agree: int, layouts: int = 1) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of `nodes` (fp, stored), enough to connect all
    that a chain of near pairs connects. In a dense group each cell gives its own links, up to one a
    fingerprint and choice of blocks; they are thinned before anything is joined with them."""
    keyed = bucketed(nodes, blocks, agree, layouts)
    sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    parts = F.ceil(F.col("n") / CELL).cast("int")
    placed = keyed.join(sizes.hint("merge"), "key").select(
        "key", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("side")
    )
    cells = placed.select("key", "fp", "side", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = cells.select(
        F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("cell"),
        "fp", "side", (F.col("side") == F.col("other")).alias("same"),
    )
    pivots = references()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def found(columns: list[np.ndarray]) -> pa.RecordBatch:
            cell, fp, side, same = columns
            fp = fp.view(np.uint64)
            a, b = near_pairs(fp, cell, side, same, distance, pivots)
            label = components(len(fp), a, b)
            child = np.flatnonzero(label != np.arange(len(fp)))
            ends = [pa.array(fp[x].view(np.int64)) for x in (label[child], child)]
            return pa.RecordBatch.from_arrays(ends, ["a", "b"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(pair) for pair in zip(rest, columns)]
            cell = columns[0]
            whole = int(np.searchsorted(cell, cell[-1], "left")) if len(cell) else 0
            if whole:
                yield found([c[:whole] for c in columns])
            rest = [c[whole:].copy() for c in columns]
        if rest is not None and len(rest[0]):
            yield found(rest)

    dealt = cells.repartition("cell").sortWithinPartitions("cell", "fp")
    found = dealt.mapInArrow(run, "a bigint, b bigint").distinct()
    for _ in range(THIN):
        found = thinned(found)
    return found


def connect(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); all of a component have one root.

    In each round every node moves to the first of itself and its neighbours, in an order that
    changes with the round; links then join where their ends moved, and rounds end with the last
    link. Each round leaves a fixed share of the nodes on average. A node that very many others
    move to is a hot join key, which Spark splits at run time."""
    edges = stored(edges.where("a <> b"), "links")
    moves = []
    while not edges.isEmpty():
        turn = F.lit(len(moves))
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.min_by("b", F.xxhash64("b", turn))
        nearest = ends.groupBy("a").agg(first.alias("near"))
        target = F.when(F.xxhash64("near", turn) < F.xxhash64("a", turn), F.col("near")).otherwise(F.col("a"))
        moved = stored(nearest.select(F.col("a").alias("node"), target.alias("root")), "moves")
        moves.append(moved)
        edges = edges.join(moved.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        edges = edges.join(moved.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = stored(edges.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves.pop()
    while moves:
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("last"))
        roots = moves.pop().join(later, "root", "left")
        roots = stored(roots.select("node", F.coalesce("last", "root").alias("root")), "roots")
    return roots


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The (node, root) of `roots` (stored) with further links (a, b) of nodes, known or new; stored. Only
    links between components are connected, so that earlier ones cost nothing again."""
    for end in ("a", "b"):
        known = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        edges = edges.join(known, end, "left")
    later = connect(edges.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    moved = roots.join(later.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left")
    moved = moved.select("node", F.coalesce("last", "root").alias("root"))
    return stored(moved.unionByName(later.join(roots, "node", "left_anti")), "roots")


def shingles(text: str, words: int) -> np.ndarray:
    """The set of a text's shingles, sorted."""
    return np.unique(shingle_values(text, words))


def sampled(docs: DataFrame, words: int, text: str) -> DataFrame:
    """Counts (h, n) of the shingles that occur in more than one text of a sample."""
    rows = numbered(docs, text, []).where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(SAMPLE)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PART):
            found = np.concatenate([shingles(t.as_py(), words) for t in batch.column(0)])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    return mapped(rows.select("text"), run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")


def reduced(docs: DataFrame, words: int, text: str, carry: Sequence[str], levels: Broadcast, similarity: float) -> DataFrame:
    """Rows (row, doc, fp, digest, n, parities, keys): a fingerprint, a 128-bit digest of the set of
    shingles, their number, their parities and the prefix. The sets themselves are several times as
    large and are kept nowhere: the few texts to be compared are hashed again."""
    rows = numbered(docs, text, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PART):
            hashes = [shingle_values(t.as_py(), words) for t in batch.column(1)]
            prints = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in hashes]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            arrays = [
                batch.column(0), batch.column(2), pa.array(prints), digests, pa.array([len(s) for s in sets], pa.int64()),
                pa.array([parities(s).tobytes() for s in sets], pa.binary()),
                as_lists([prefix(s, levels.value, similarity) for s in sets]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc", "fp", "digest", "n", "parities", "keys"])

    doc = rows.schema["doc"].dataType.simpleString()
    return mapped(rows, run, f"row bigint, doc {doc}, fp bigint, digest binary, n bigint, parities binary, keys array<bigint>")


def as_lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))


def as_sets(lists: pa.Array) -> list[np.ndarray]:
    values, ends = np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets)
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def top_bits(name: str, bits: int) -> Column:
    return F.shiftrightunsigned(name, 64 - bits)


def bit_table(values: DataFrame, name: str, level: Column | None = None) -> np.ndarray:
    """2 ** BITS bits as bytes. Without a level, the bit of a value's highest bits is set; with one,
    the value has a byte, in which as many low bits are set. At most 2 ** (BITS - 6) rows are read."""
    if level is None:
        place, bit = top_bits(name, BITS), F.lit(1).cast("long")
        spot = F.expr(f"cast(shiftrightunsigned({name}, {64 - BITS}) & 63 as int)")
        at = F.shiftright(place, 6)
    else:
        place, bit = top_bits(name, BITS - 3), F.expr("shiftleft(1L, least(level, 8)) - 1")
        spot = F.expr(f"cast(shiftrightunsigned({name}, {64 - BITS + 3}) & 7 as int) * 8")
        at = F.shiftright(place, 3)
        values = values.withColumn("level", level.cast("int"))
    found = values.select(at.cast("int").alias("at"), bit.alias("bit"), spot.alias("spot"))
    found = found.select("at", F.expr("shiftleft(bit, spot)").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    kept = stored(found, "bits")
    found = kept.toPandas()
    discarded(kept)
    bits = np.zeros(1 << BITS - 6, "<i8")
    bits[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bits.view(np.uint8)


def is_set(table_of: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values >> np.uint64(64 - BITS)
    return (table_of[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1) == 1


def prefix(values: np.ndarray, levels: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set, rarest first, as far as a set of that similarity must share one."""
    need = math.ceil(similarity * len(values) - 1e-9)
    order = np.lexsort((values, levels[(values >> np.uint64(64 - BITS + 3)).astype(np.int64)]))
    return values[order[: len(values) - need + 1]] if len(values) else values


def parities(values: np.ndarray) -> np.ndarray:
    """For each value of the low bits, whether an odd number of shingles has it: two sets differ in
    at least as many shingles as their parities in bits. There is a bit for each shingle or two."""
    bits = max(64 * PARITY, 1 << (len(values) - 1).bit_length() if len(values) else 0)
    counts = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1, bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parities of fewer low bits, in `size` bytes."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def most_apart(n: int | Column, m: int | Column, similarity: float) -> float | Column:
    """The most shingles in which two similar sets of n and m differ."""
    return (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6


def over(rows: DataFrame, nodes: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> tuple[DataFrame, Broadcast]:
    """What `make` gives for batches of those `rows` (node first) that are in `nodes`, and of some
    others: those whose bit is set in a table of fixed size. The table goes to all executors; it is to be
    destroyed once the rows are stored."""
    shared = rows.sparkSession.sparkContext.broadcast(bit_table(nodes.select(F.xxhash64("node").alias("h")), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PART):
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            some = batch.filter(pa.array(is_set(shared.value, hashes)))
            if len(some):
                yield make(some.select(some.schema.names[1:]))

    return mapped(rows.select(F.xxhash64("node").alias("_hash"), "*"), run, schema), shared


def near_enough(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of nodes (stored), those that the parities of their sets leave; stored. `prints` has
    (node, n, parities)."""
    nodes = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "asked")
    found, bits = over(prints.select("node", "n", "parities"), nodes, lambda batch: batch, "node bigint, n bigint, parities binary")
    some = stored(found.join(nodes, "node", "left_semi"), "parities")
    bits.destroy()
    both = pairs.join(some.select(F.col("node").alias("a"), "n", "parities"), "a")
    both = both.join(some.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("parities").alias("others")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for n, m, s, t in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                size = min(len(s), len(t))
                differ = folded(np.frombuffer(s, np.uint8), size) ^ folded(np.frombuffer(t, np.uint8), size)
                kept.append(int(np.bitwise_count(differ).sum()) <= most_apart(n, m, similarity))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    left = stored(mapped(both.select("a", "b", "n", "m", "parities", "others"), run, "a bigint, b bigint"), "near-enough")
    discarded(some, nodes)
    return left


def verified(texts: DataFrame, words: int, prints: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of nodes (stored), those whose shingle sets are similar; stored. `texts` has
    (node, text); only texts of pairs that their parities leave are hashed."""
    pairs = near_enough(pairs, prints, similarity)
    nodes = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "asked")

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = as_lists([shingles(t.as_py(), words) for t in batch.column(1)])
        return pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "s"])

    found, bits = over(texts, nodes, sets_of, "node bigint, s array<bigint>")
    asked = stored(found.join(nodes, "node", "left_semi"), "sets")
    bits.destroy()
    both = pairs.join(asked.select(F.col("node").alias("a"), F.col("s").alias("s")), "a")
    both = both.join(asked.select(F.col("node").alias("b"), F.col("s").alias("t")), "b")
    shared = F.size(F.array_intersect("s", "t"))
    union = F.size("s") + F.size("t") - shared
    alike = stored(both.where((union == 0) | (shared / union >= similarity)).select("a", "b"), "verified")
    discarded(asked, nodes, pairs)
    return alike


def similar(texts: DataFrame, words: int, prints: DataFrame, nodes: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of all components by similar pairs among `nodes` (rows with distinct sets,
    stored), of which `edges` are some; nodes without a link may be missing. `texts` has (node, text),
    `prints` (node, n, parities, keys).

    Two similar sets share one of the shingles of their prefixes, whatever the order of shingles;
    here common ones come last, as a sample of the texts counts them, so that buckets stay small.
    A bucket's members are not all paired: a few heads meet all others, pairs of one component,
    of unfit sizes or parities are left out, and what fits is verified. Heads then leave, and
    buckets of one component are done. The number of heads grows with each round until no bucket
    is left; so a group of near copies costs a round, and unlike members cost at most all pairs."""
    spark = nodes.sparkSession

    def keys_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(1).flatten()], ["key"])

    keys, known = over(prints.select("node", "keys"), nodes, keys_of, "key bigint")
    met = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    often = spark.sparkContext.broadcast(bit_table(met.select("key"), "key"))
    known.destroy()

    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [k[is_set(often.value, k)] for k in as_sets(batch.column(3))]
        low = [folded(np.frombuffer(p, np.uint8), 8 * PARITY).view("<i8") for p in batch.column(2).to_pylist()]
        same = [(node, n, *p.tolist()) for node, n, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), low)]
        own = np.repeat(np.array(same, np.int64), [len(k) for k in keys], axis=0)
        columns = [np.concatenate(keys).view(np.int64), *own.T]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], NAMES)

    schema = ", ".join(f"{n} bigint" for n in NAMES)
    found, known = over(prints.select("node", "n", "parities", "keys"), nodes, rows_of, schema)
    kept = rows = stored(found.join(nodes, "node", "left_semi").select(*NAMES), "prefixes")
    known.destroy()
    often.destroy()
    heads_each, past = 4, []
    roots = connect(edges)
    while True:
        rows = rows.join(roots.withColumnRenamed("root", "comp"), "node", "left")
        rows = rows.withColumn("comp", F.coalesce("comp", "node"))
        live = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        live, former = stored(live.select("key"), "live"), kept
        kept = rows = stored(rows.join(live, "key", "left_semi"), "bucket-rows")
        discarded(former, live, *past)
        if rows.isEmpty():
            return roots
        part = F.pmod(F.xxhash64("node", F.lit(heads_each)), F.lit(heads_each))
        first = F.min(F.struct("n", "node", "comp", *NAMES[3:])).alias("head")
        heads = stored(rows.groupBy("key", part.alias("part")).agg(first).select("key", "head"), "heads")
        n, m = F.col("n"), F.col("head.n")
        apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"head.{p}"))) for p in NAMES[3:]), F.lit(0))
        fits = (F.least(n, m) >= F.greatest(n, m) * similarity - 1e-6) & (apart <= most_apart(n, m, similarity))
        pairs = rows.join(heads, "key").where((F.col("comp") != F.col("head.comp")) & fits)
        pairs = stored(pairs.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct(), "pairs")
        roots = merged(roots, verified(texts, words, prints, pairs, similarity))
        past = [heads, pairs]
        gone = heads.select("key", F.col("head.node").alias("node"))
        rows = rows.drop("comp").join(gone, ["key", "node"], "left_anti")
        heads_each *= 8


def group_near(
    docs: DataFrame, words: int = 5, distance: int = 8, blocks: int = 8, agree: int = 3, layouts: int = 3,
    doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = (), similarity: float | None = None,
) -> DataFrame:
    """Columns fp, component_id, first and those of `carry`, one row per input row.

    Texts link when their fingerprints over `words`-word shingles (A-Z as a-z) differ in at most
    `distance` bits; component_id is the smallest id reachable, `first` is true for one row of
    each component, the one with that id. Null text is empty; texts without words have
    fingerprint 0; shorter texts are one shingle. Null ids are greatest; among repeated rows with
    the smallest id one is first. No rows give no rows.

    With `similarity`, texts link instead when the Jaccard similarity of their shingle sets is at
    least that, all such pairs and no others (as far as 64-bit hashes tell shingles apart): links
    by fingerprint are only candidates then, and `similar` finds what they miss. The fingerprints are
    then of other hashes than XXH64.

    Fingerprints meet where they agree on `agree` of `blocks` blocks of bits, in one of `layouts`
    of the blocks. Up to `blocks - agree` differing bits that is certain, and the result by bits is
    exact if `distance` is no more. Three layouts of eight blocks, of which three agree, find all
    pairs with up to five differing bits, and of those with six, seven and eight 99, 93 and 80 %.
    More agreeing blocks make longer keys, which larger collections need: buckets grow with the
    number of texts per key."""
    kept = [*dict.fromkeys([doc_id, *carry])]
    with small_broadcasts(docs.sparkSession):
        small, owner, unit = owned(docs, words, distance, blocks, agree, layouts, doc_id, text, similarity)
    if kept == [doc_id]:
        found = small.join(owner.hint("merge"), unit)
    else:
        placed = small.join(owner.hint("merge"), unit).select("row", "fp", "component_id", "lead_row")
        found = numbered(docs, text, carry).drop("text").join(placed.hint("merge"), "row")
    return found.select(*carried(carry), "fp", "component_id", (F.col("row") == F.col("lead_row")).alias("first"))


def owned(
    docs: DataFrame, words: int, distance: int, blocks: int, agree: int, layouts: int, doc_id: str, text: str, similarity: float | None
) -> tuple[DataFrame, DataFrame, str]:
    """What `group_near` finds, stored: rows (row, doc, fp) with the name of what stands for a text, which is
    told last, and for each value of that the component_id and lead_row."""
    lead = F.min(F.struct(F.col("doc").getField(doc_id).isNull().alias("none"), F.col("doc").getField(doc_id).alias("id"), "row"))
    if similarity is None:
        unit = "fp"
        small = stored(fingerprints(docs, words, text, [doc_id]), "fingerprints")
        nodes = stored(small.groupBy("fp").agg(lead.alias("lead")), "nodes")
        roots = connect(links(nodes.select("fp"), distance, blocks, agree, layouts)).withColumnRenamed("node", "fp")
        rooted = nodes.join(roots, "fp", "left").select("fp", "lead", F.coalesce("root", "fp").alias("root"))
    else:
        unit = "digest"
        levels = docs.sparkSession.sparkContext.broadcast(bit_table(sampled(docs, words, text), "h", F.floor(F.log2("n"))))
        small = stored(reduced(docs, words, text, [doc_id], levels, similarity), "reduced")
        levels.destroy()
        prints = small.select(F.col("row").alias("node"), "n", "parities", "keys")
        texts = numbered(docs, text, []).select(F.col("row").alias("node"), "text")
        nodes = small.groupBy("digest").agg(lead.alias("lead"), F.min("fp").alias("fp"))
        nodes = stored(nodes.withColumn("node", F.col("lead.row")), "nodes")
        heads = stored(nodes.groupBy("fp").agg(F.min("node").alias("head")), "fingerprint-heads")
        near = links(heads.select("fp"), distance, blocks, agree, layouts)
        near = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a")
        near = near.join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
        near = near.unionByName(nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("x"), F.col("node").alias("y")))
        near = stored(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "candidates")
        near = verified(texts, words, prints, near, similarity)
        roots = similar(texts, words, prints, nodes.select("node"), near, similarity)
        rooted = nodes.join(roots, "node", "left").select("digest", "lead", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted")
    best = stored(rooted.groupBy("root").agg(F.min("lead").alias("lead")), "leads")
    owner = stored(
        rooted.drop("lead").join(best, "root").select(unit, F.col("lead.id").alias("component_id"), F.col("lead.row").alias("lead_row")),
        "owners",
    )
    return small, owner, unit


def op4_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group_near(table(spark, sf_dir, "documents"), words=4, distance=4, blocks=6, agree=2, layouts=1, carry=["doc_id"])
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

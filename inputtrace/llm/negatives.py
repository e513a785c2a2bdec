"""Hard negatives by cover trees over norm-augmented vectors.

All vectors get one more component that brings them to the same length, so that the largest inner
products belong to the smallest angles. Candidates are dealt into blocks: by label, by the nearest
of a few pivots, and by hash where such a group is large. A task builds the cover tree of a block.
Each level covers a node's vectors by children of a smaller radius, and the radius bounds the inner
products below a node on both sides. An anchor descends best first, leaves out nodes that lie outside
its window or cannot reach its best ones, and computes the vectors in leaves exactly.

The anchors are the stated queries: each meets every block that may hold its partners, and tasks
take bounded blocks of candidates and of anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inputtrace.llm.common import hold_splits, mapped, stored, table

BLOCK = 4096  # candidates of a tree, about
ANCHORS = 1 << 16  # anchors of a task, about
PIVOTS = 1024  # at most, which reach the driver and all tasks
LABEL_PARTS = 16
LEAF = 16  # vectors of a leaf; more if they are alike
STEP = 64  # nodes that a query opens in a round
PAIRS = 1 << 16  # products computed at once
CELLS = 1 << 21  # bounds held at once
BASE = 1.3  # radius of a level to that of the next
SLACK = 1e-6  # of an angle, for rounding
SCALE = 256  # fixed by the query's contract


def matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Lists as rows of 64-bit integers; shorter ones end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths(), np.int64)
    flat = np.asarray(lists.flatten(), np.int64)
    width = max(width, int(lengths.max(initial=0)))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    found = np.zeros((len(lengths), width), np.int64)
    found[np.arange(width) < lengths[:, None]] = flat
    return found


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, by floating point where that is exact."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if largest < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class CoverTree:
    """The tree of some vectors. Nodes lie level by level: children of a node, and the vectors below
    it, are neighbours. A node's centre is one of its vectors, and that of its first child."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.norm = max(float(lengths.max(initial=0)), 1.0)
        more = np.sqrt(np.maximum(self.norm**2 - lengths**2, 0))
        unit = np.column_stack([vectors, more]) / self.norm  # augmented, on the unit sphere
        self.order = np.arange(len(vectors))
        self.center, self.radius, self.kids, self.span = [], [], [], []
        todo: list[tuple[int, int]] = [(0, len(vectors))] if len(vectors) else []
        at = 0
        while at < len(todo):
            start, end = todo[at]
            own = self.order[start:end]
            angle = np.arccos(np.clip(unit[own] @ unit[own[0]], -1, 1))
            radius = float(angle.max())
            kids = (0, 0)
            if len(own) > leaf and radius > SLACK:
                left, cuts, parts = own, start, []
                before = len(todo)
                while len(left):
                    near = np.arccos(np.clip(unit[left] @ unit[left[0]], -1, 1)) <= radius / BASE
                    near[0] = True
                    parts.append(left[near])
                    left = left[~near]
                for part in parts:
                    self.order[cuts : cuts + len(part)] = part
                    todo.append((cuts, cuts + len(part)))
                    cuts += len(part)
                kids = (before, len(todo))
            self.center.append(int(own[0]))
            self.radius.append(radius + SLACK)
            self.kids.append(kids)
            self.span.append((start, end))
            at += 1
        self.center, self.radius = np.array(self.center, np.int64), np.array(self.radius)
        self.kids = np.array(self.kids, np.int64).reshape(-1, 2)
        self.span = np.array(self.span, np.int64).reshape(-1, 2)
        self.vectors = vectors

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest inner product of each query with what lies below each node."""
        lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(1))[:, None] * self.norm
        angle = products(queries, self.vectors[self.center]) / np.maximum(lengths, 1e-300)
        angle = np.arccos(np.clip(angle, -1, 1))
        most = np.cos(np.maximum(angle - self.radius, 0)) * lengths
        least = np.cos(np.minimum(angle + self.radius, np.pi)) * lengths
        return least - lengths * 1e-12, most + lengths * 1e-12

    def best(
        self, queries: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], k: int, low: np.ndarray, high: np.ndarray,
        ids: np.ndarray, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray],
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the k largest products from `low` to `high`, as columns (query, product,
        place), ties by id, then place. `allowed` says which pairs of query and place count.

        All queries descend together, each by its own `STEP` best open nodes a round. What a round
        finds raises the floor below which a query leaves nodes out."""
        least, most = bounds
        none = np.empty(0, np.int64)
        query, product, place = none, none, none
        open_nodes = np.zeros(most.shape, bool)
        if most.shape[1]:
            open_nodes[:, 0] = least[:, 0] <= high
        floor = low.copy()
        while True:
            live = np.where(open_nodes & (most >= floor[:, None]), most, -np.inf)
            if live.shape[1] > STEP:
                column = np.argpartition(live, -STEP, axis=1)[:, -STEP:]
                some, at = np.nonzero(np.take_along_axis(live, column, 1) > -np.inf)
                node = column[some, at]
            else:
                some, node = np.nonzero(live > -np.inf)
            if not len(some):
                return query, product, place
            open_nodes[some, node] = False
            inner = self.kids[node, 1] > self.kids[node, 0]
            who, kid = spread(some[inner], self.kids[node[inner]])
            open_nodes[who, kid] = least[who, kid] <= high[who]
            who, at = spread(some[~inner], self.span[node[~inner]])
            at = self.order[at]
            keep = allowed(who, at)
            who, at = who[keep], at[keep]
            score = self.pair_products(queries, who, at)
            keep = (score >= floor[who]) & (score <= high[who])
            query = np.concatenate((query, who[keep]))
            product = np.concatenate((product, score[keep]))
            place = np.concatenate((place, at[keep]))
            sort = np.lexsort((place, ids[place], -product, query))
            query, product, place = query[sort], product[sort], place[sort]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            full = rank == k - 1
            floor[query[full]] = np.maximum(floor[query[full]], product[full])
            query, product, place = query[rank < k], product[rank < k], place[rank < k]

    def pair_products(self, queries: np.ndarray, who: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact products of pairs of a query and a vector."""
        found = np.empty(len(who), np.int64)
        for start in range(0, len(who), PAIRS):
            cut = slice(start, start + PAIRS)
            found[cut] = np.einsum("ij,ij->i", queries[who[cut]], self.vectors[at[cut]])
        return found


def spread(who: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number of each range, beside the query the range is for."""
    sizes = ranges[:, 1] - ranges[:, 0]
    before = np.cumsum(sizes) - sizes
    return np.repeat(who, sizes), np.arange(sizes.sum()) + np.repeat(ranges[:, 0] - before, sizes)


def prepared(rows: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """Stored rows (row, vec_id, label, v): components in whole steps, and a number that tells rows
    apart, given once. Rows that take no part are gone."""
    hold_splits(rows.sparkSession)
    parts = F.col(f"`{vector}`")
    finite = F.forall(parts, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.where(F.col(f"`{vec_id}`").isNotNull() & label.isNotNull() & parts.isNotNull() & finite)
    whole = F.transform(parts, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("bigint"))
    return stored(
        kept.select(
            F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"),
            label.cast("bigint").alias("label"), whole.alias("v"),
        ),
        "vectors",
    )


class Blocks:
    """Candidates dealt into numbered blocks of about `size`. Blocks of one part of the labels follow
    each other. Pivots are `PIVOTS` rows at most, by the hash of their number."""

    def __init__(self, rows: DataFrame, size: int = BLOCK):
        spark = rows.sparkSession
        total = rows.count()
        pivots = min(PIVOTS, max(1, -(-total // size)))
        chosen = rows.orderBy(F.xxhash64("row"), "row").limit(pivots).select("v").toArrow()
        centers = matrix(chosen.column("v")).astype(np.float64)
        centers /= np.maximum(np.sqrt((centers**2).sum(1, keepdims=True)), 1e-300)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = matrix(batch.column(3), centers.shape[1])
                part = vectors[:, : centers.shape[1]].astype(np.float64) @ centers.T
                arrays = [*batch.columns, pa.array(part.argmax(1) if len(batch) else [], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "pivot"])

        part = F.pmod(F.xxhash64("label"), F.lit(LABEL_PARTS)).alias("part")
        schema = "row bigint, vec_id bigint, label bigint, v array<bigint>, pivot bigint"
        dealt = stored(mapped(rows, nearest, schema).select("*", part), "dealt")
        groups = dealt.groupBy("part", "pivot").count().orderBy("part", "pivot").collect()  # 16 x 1,024 at most
        self.count, firsts, self.of_part = 0, [], {}
        for group in groups:
            salts = -(-group["count"] // size)
            firsts.append((group["part"], group["pivot"], self.count, salts))
            begin, _ = self.of_part.get(group["part"], (self.count, 0))
            self.count += salts
            self.of_part[group["part"]] = (begin, self.count)
        places = F.broadcast(spark.createDataFrame(firsts, "part bigint, pivot bigint, first bigint, salts bigint"))
        salt = F.pmod(F.xxhash64("row", F.lit(1)), F.col("salts"))
        self.rows = dealt.join(places, ["part", "pivot"]).select("row", "vec_id", "label", "v", (F.col("first") + salt).alias("block"))

    def numbers(self, part: Column | None = None) -> Column:
        """Numbers of all blocks, or of those of a part of the labels."""
        if part is None:
            return F.sequence(F.lit(0), F.lit(max(self.count, 1) - 1)).cast("array<bigint>")
        found = F.array().cast("array<bigint>")
        for own, (begin, end) in self.of_part.items():
            found = F.when(part == own, F.sequence(F.lit(begin), F.lit(end - 1)).cast("array<bigint>")).otherwise(found)
        return found

    def search(self, anchors: DataFrame, blocks: Column, groups: int, schema: str, find: Callable) -> DataFrame:
        """Rows that `find` gives for each block and the anchors that meet it, anchors in `groups` parts."""
        group = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(groups)).alias("group")
        left = self.rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
        right = anchors.select("*", group, F.explode(blocks).alias("block"))
        names = [c.split()[0] for c in schema.split(", ")]

        def run(_, candidates: pa.Table, queries: pa.Table) -> pa.Table:
            if not len(candidates) or not len(queries):
                return pa.table([pa.array([], pa.int64())] * len(names), names)
            vectors, asked = matrix(candidates.column("v")), matrix(queries.column("v"))
            width = max(vectors.shape[1], asked.shape[1])
            vectors, asked = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, asked))
            tree = CoverTree(vectors)
            told = {c: np.asarray(candidates.column(c)) for c in ("row", "vec_id", "label")}
            size = max(1, CELLS // len(tree.center))
            parts = [
                find(tree, told, queries.slice(start, size), asked[start : start + size])
                for start in range(0, len(asked), size)
            ]
            return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts)], names)

        pair = left.groupBy("block", "group").cogroup(right.groupBy("block", "group"))
        return pair.applyInArrow(run, schema)


def _positives(k: int):
    def find(tree: CoverTree, told: dict, queries: pa.Table, asked: np.ndarray) -> tuple:
        row, label = np.asarray(queries.column("row")), np.asarray(queries.column("label"))
        free = np.full(len(row), np.inf)
        who, score, place = tree.best(
            asked, tree.bounds(asked), k, -free, free, told["vec_id"],
            lambda q, at: (told["label"][at] == label[q]) & (told["row"][at] != row[q]),
        )
        return row[who], score, told["vec_id"][place], told["row"][place]

    return find


def _negatives(k: int, low: int):
    def find(tree: CoverTree, told: dict, queries: pa.Table, asked: np.ndarray) -> tuple:
        row, label = np.asarray(queries.column("row")), np.asarray(queries.column("label"))
        lists = queries.column("scores").combine_chunks()
        high = np.asarray(lists.flatten(), np.int64)
        sizes = np.asarray(lists.value_lengths(), np.int64)
        anchor, window = spread(np.arange(len(row)), np.column_stack((sizes * 0, sizes)))
        least = -(-low * high // 100)
        bounds = tree.bounds(asked)
        parts = []
        for n in range(int(sizes.max(initial=0))):  # the windows of one place; an anchor has few
            own = np.flatnonzero((window == n) & (least <= high))
            a = anchor[own]
            who, score, place = tree.best(
                asked[a], tuple(b[a] for b in bounds), k, least[own].astype(float), high[own].astype(float), told["vec_id"],
                lambda q, at, a=a: told["label"][at] != label[a[q]],
            )
            parts.append((row[a[who]], np.full(len(who), n), score, told["vec_id"][place], told["row"][place]))
        return tuple(np.concatenate(c) for c in zip(*parts))

    return find


def hard_negatives(
    rows: DataFrame, anchor: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding",
    positives: int = 5, negatives: int = 5, low: int = 80, block: int = BLOCK,
) -> DataFrame:
    """Columns anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each
    anchor and each of its best rows of the same label, the best rows of other labels whose score
    is from `low` percent of the positive's up to the positive's.

    `anchor` is a condition on vec_id, `label` an expression on the input's columns. A row's score
    is its exact inner product with the anchor in steps of 1/256; ties go to the smaller vec_id,
    then to the earlier row. Rows with a null id, label or vector, or a null or non-finite component take
    no part. Shorter vectors count as ending in zeros; products beyond 64 bits are not kept apart.
    An anchor without rows of its label, or a positive without rows in the window, gives no rows;
    neither does an empty table. Repeated rows are rows of their own. Other columns are not read."""
    whole = prepared(rows, vec_id, vector, label)
    blocks = Blocks(whole, block)
    part = F.pmod(F.xxhash64("label"), F.lit(LABEL_PARTS))
    anchors = whole.where(anchor)
    groups = max(1, -(-anchors.count() // ANCHORS))

    found = blocks.search(
        anchors, blocks.numbers(part), groups, "row bigint, score bigint, vec_id bigint, other bigint", _positives(positives)
    )
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    best = F.array_sort(F.collect_list(F.struct("n", "score", "vec_id"))).alias("best")
    told = stored(found.groupBy("row").agg(best), "positives")
    asked = anchors.join(told, "row").select("*", F.col("best.score").alias("scores"), F.col("best.vec_id").alias("positive_ids"))
    asked = stored(asked.drop("best"), "windows")

    found = blocks.search(
        asked.drop("positive_ids"), blocks.numbers(), groups,
        "row bigint, place bigint, score bigint, vec_id bigint, other bigint", _negatives(negatives, low),
    )
    order = Window.partitionBy("row", "place").orderBy(F.desc("score"), "vec_id", "other")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    names = asked.select("row", F.col("vec_id").alias("anchor_id"), "positive_ids", "scores")
    place = F.col("place").cast("int") + 1
    return found.join(names, "row").select(
        "anchor_id", F.element_at("positive_ids", place).alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.element_at("scores", place).alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op13_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, moved)


OP13_SQL = """
with vectors as (
    select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
    select a.r as anchor, a.vec_id as anchor_id, b.r as other, b.vec_id, a.label = b.label as same,
        list_dot_product(a.v, b.v)::bigint as score
    from vectors a join vectors b on a.r <> b.r
    where a.vec_id % 100 = 0
), positives as (
    select * from pairs where same
    qualify row_number() over (partition by anchor order by score desc, vec_id, other) <= 5
)
select p.anchor_id, p.vec_id as positive_id,
    row_number() over (partition by p.anchor, p.other order by n.score desc, n.vec_id, n.other)::integer as rank,
    n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join pairs n on p.anchor = n.anchor and not n.same
    and 80 * p.score <= 100 * n.score and n.score <= p.score
qualify rank <= 5
"""

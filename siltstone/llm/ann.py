"""Approximate nearest neighbours by a hierarchical k-means tree that is searched best bin first.

The tree is fitted to a bounded sample of the distinct vectors; then every row goes down it to its leaf. A query takes the
leaves in the order of a priority queue: the branch whose centre is nearest is followed to a leaf, and all that it passes
by wait in the queue. How many leaves a query visits is calibrated: CALIBRATION queries are answered by comparing them
with every row, their leaf visits are widened until RECALL of these answers is found, and all queries visit as many.

Visits are made in two waves. The first few leaves give every query the distance of its k-th best answer; the other
leaves return only what is as near, so that partial answers don't grow with the visits. Rows of a leaf and the queries
that visit it meet in cells (leaf, shard of its rows, block of its queries), sorted so that the queries come first and the
rows stream by them: a task holds the queries of a block and a batch of rows, however many copies of a vector there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import cut, map_arrow, table

TOP = 10
#: Share of the true answers of the calibration queries that visits are widened to; the contract asks for 0.9.
RECALL, CALIBRATION = 0.95, 256
#: Leaves: the square root of the number of rows within these bounds. Children of a node.
LEAVES, BRANCH = (16, 8192), 16
#: Vectors of the sample for each leaf; numbers of the whole sample at most.
PER_LEAF, SAMPLE_NUMBERS = 16, 1 << 23
#: Rows of a shard and queries of a block, on average.
SHARD, QUERY_BLOCK = 100_000, 5_000
#: The first wave makes one of so many visits.
FIRST_WAVE = 8

_HASHES = 1 << 40
_FOUND = "query_row long, query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part: without null or non-finite components, and not zero."""
    element = "float" if "array<float>" == vectors.schema["embedding"].dataType.simpleString() else "double"
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("v")).where("v is not null")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return found.where(~bad & F.exists("v", lambda c: c != 0))


def dense(lists: pa.Array, width: int) -> np.ndarray:
    """The lists as rows of doubles, with zeros up to width."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy()
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, but for rounding."""
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1), 0)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """The cluster of each row of x; the first centres are drawn far from one another."""
    rng = np.random.default_rng(len(x))
    centres = x[[0]]
    for _ in range(k - 1):
        far = _distances(x, centres).min(axis=1)
        if far.sum() <= 0:
            break
        centres = np.append(centres, x[[rng.choice(len(x), p=far / far.sum())]], axis=0)
    for _ in range(rounds):
        own = _distances(x, centres).argmin(axis=1)
        centres = np.array([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
    return _distances(x, centres).argmin(axis=1)


class Tree:
    """Centres of the nodes, children of each (none: a leaf), the number of each leaf and the node of each number."""

    def __init__(self, sample: np.ndarray, leaves: int):
        per = max(1, len(sample) / leaves)
        self.centres, self.children, self.leaf = [sample.mean(axis=0)], [[]], [-1]
        todo, self.leaves = [(0, np.arange(len(sample)))], 0
        while todo:
            node, rows = todo.pop()
            k = min(BRANCH, round(len(rows) / per))
            cluster = k_means(sample[rows], k) if k > 1 else np.zeros(len(rows), np.int64)
            parts = [rows[cluster == c] for c in np.unique(cluster)]
            if len(parts) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            for part in parts:
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), part))
                self.centres.append(sample[part].mean(axis=0))
                self.children.append([])
                self.leaf.append(-1)
        self.centres = np.array(self.centres)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row of x goes down to."""
        out, todo = np.empty(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            below = self.children[node]
            nearest = _distances(x[rows], self.centres[below]).argmin(axis=1)
            todo += [(below[c], rows[nearest == c]) for c in np.unique(nearest)]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                below = self.children[node]
                far = ((self.centres[below] - q) ** 2).sum(axis=1).tolist()
                best = min(range(len(below)), key=far.__getitem__)
                for c, d in enumerate(far):
                    if c != best:
                        heapq.heappush(queue, (d, below[c]))
                node = below[best]
            yield self.leaf[node]


class Best:
    """The k nearest rows of each query among all that were offered; ties to the lesser id, null ids last."""

    def __init__(self, names: np.ndarray, ids: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int):
        self.names, self.ids, self.x, self.bound, self.k = names, ids, x, bound.copy(), k
        self.found = [(np.empty(0), np.empty(0, bool), np.empty(0, np.int64))] * len(names)

    def offer(self, rows: np.ndarray, ids: pa.Array, x: np.ndarray) -> None:
        none, plain = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        size, most = (self.x**2).sum(axis=1), float((x**2).sum(axis=1).max(initial=0))
        for a in range(0, len(self.names), 256):
            square = _distances(self.x[a : a + 256], x)
            square[self.names[a : a + 256, None] == rows] = np.inf
            limit = self.bound[a : a + 256] ** 2
            if len(rows) > self.k:
                limit = np.minimum(limit, np.partition(square, self.k - 1, axis=1)[:, self.k - 1])
            limit = limit + 1e-9 * (size[a : a + 256] + most)  # more than is lost by rounding
            near = (square <= limit[:, None]) & np.isfinite(square)
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                at, q = np.flatnonzero(near[i]), self.x[a + i]
                score = np.sqrt(((x[at] - q) ** 2).sum(axis=1))
                old = self.found[a + i]
                score, no_id, other = (np.concatenate(c) for c in zip(old, (score, none[at], plain[at]), strict=True))
                order = np.lexsort((other, no_id, score))[: self.k]
                self.found[a + i] = (score[order], no_id[order], other[order])
                if len(order) == self.k:
                    self.bound[a + i] = min(self.bound[a + i], score[order[-1]])

    def answers(self):
        """(query's row, query's id, vec_id, score); what is beyond the bound is left out."""
        keep = [score <= b for (score, _, _), b in zip(self.found, self.bound, strict=True)]
        size = np.array([m.sum() for m in keep], np.int64)
        score, none, ids = (np.concatenate([f[i][m] for f, m in zip(self.found, keep, strict=True)]) for i in range(3))
        return [np.repeat(self.names, size), np.repeat(self.ids, size), pa.array(ids, pa.int64(), mask=none), score]


def fitted(rows: DataFrame, total: int, width: int) -> Tree:
    """The tree of the vectors of rows(v): of a sample by their hash of at most some SAMPLE_NUMBERS / width of them."""
    leaves = min(max(isqrt(total), LEAVES[0]), LEAVES[1])
    wanted = max(1, min(leaves * PER_LEAF, SAMPLE_NUMBERS // width))
    hashed = F.xxhash64("v")
    distinct = rows.agg(F.approx_count_distinct(hashed)).first()[0]
    few = rows.where(F.pmod(hashed, F.lit(_HASHES)) < int(_HASHES * min(1.0, wanted / max(1, distinct))) if wanted < distinct else F.lit(True))
    sample = dense(few.select("v").distinct().toArrow().column(0).combine_chunks(), width)
    if not len(sample):
        sample = np.zeros((1, width))
    return Tree(sample[np.lexsort(sample.T[::-1])], leaves)


def calibrated(tree: Tree, asked: DataFrame, rows: DataFrame, width: int, k: int, recall: float) -> int:
    """How many leaves have to be visited so that the sampled queries find the given share of their true answers."""
    sample = asked.orderBy(F.xxhash64("vec_id", "v"), "row").limit(CALIBRATION).select("row", "vec_id", "v").toArrow().combine_chunks()
    if not sample.num_rows:
        return 1
    names, x = sample.column(0).to_numpy(), dense(sample.column(2).combine_chunks(), width)

    def compare(batches):
        best = Best(names, names, x, np.full(len(names), np.inf), k)
        for batch in batches:  # the leaf stands for the id: only it is asked for
            best.offer(batch.column(0).to_numpy(), batch.column(1).cast(pa.int64()), dense(batch.column(2), width))
        found = best.answers()
        yield [found[0], found[2], found[3]]

    true = map_arrow(rows.select("row", "leaf", "v"), compare, "query long, leaf long, score double")
    place = Window.partitionBy("query").orderBy("score", "leaf")
    leaves: dict[int, list[int]] = {}
    for r in true.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k).select("query", "leaf").collect():  # CALIBRATION * k rows
        leaves.setdefault(r.query, []).append(r.leaf)
    hits = np.zeros(tree.leaves, np.int64)
    for name, q in zip(names.tolist(), x, strict=True):
        order = {leaf: i for i, leaf in enumerate(tree.visits(q))}
        np.add.at(hits, [order[leaf] for leaf in leaves.get(name, [])], 1)
    visits = 1
    while hits[:visits].sum() < recall * hits.sum():  # widened leaf by leaf
        visits += 1
    return visits


_CELL = "leaf int, shard int, block int, kind int, row long, vec_id long, bound double, v array<{}>"


def _wave(asked: DataFrame, rows: DataFrame, tree: Tree, n_rows: dict[int, int], width: int, span: tuple[int, int], last: bool, k: int, element: str) -> DataFrame:
    """_FOUND of what the queries asked(row, vec_id, v, bound) find in the leaves of the given places in their order.

    The last wave goes on until k other rows are met, however few the leaves hold.
    """

    def order(batches):
        for batch in batches:
            lists = []
            for q in dense(batch.column(2), width):
                held, own = 0, []
                for i, leaf in enumerate(tree.visits(q)):
                    if i >= span[1] and (held > k or not last):
                        break
                    held += n_rows.get(leaf, 0)
                    if i >= span[0] and leaf in n_rows:
                        own.append(leaf)
                lists.append(own)
            yield [*batch.columns, pa.array(lists, pa.list_(pa.int32()))]

    visits = cut(map_arrow(asked, order, f"row long, vec_id long, v array<{element}>, bound double, leaves array<int>"))
    n_asked = {r.leaf: r.n for r in visits.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a leaf
    shards, parts = ({leaf: -(-n // size) for leaf, n in of.items()} for of, size in ((n_rows, SHARD), (n_asked, QUERY_BLOCK)))
    deal = lambda row, n: ((row * 2654435761 & 0x7FFFFFFFFFFFFFFF) >> 16) % n

    def ask(batches):
        """Each query to all shards of the leaves that it visits."""
        for batch in batches:
            row = batch.column(0).to_numpy()
            size = np.diff(batch.column(4).offsets.to_numpy())
            of, leaf = np.repeat(np.arange(len(row)), size), batch.column(4).flatten().to_numpy()
            times = np.array([shards[x] for x in leaf.tolist()], np.int64)
            shard = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            of, leaf = np.repeat(of, times), np.repeat(leaf, times)
            block = deal(row[of], np.array([parts[x] for x in leaf.tolist()], np.int64))
            for a in range(0, len(of), 4096):
                part = batch.take(pa.array(of[a : a + 4096]))
                yield [leaf[a : a + 4096], shard[a : a + 4096].astype(np.int32), block[a : a + 4096].astype(np.int32), np.zeros(part.num_rows, np.int32), part.column(0), part.column(1), part.column(3), part.column(2)]

    def send(batches):
        """Each row to the blocks of queries that visit its leaf."""
        for batch in batches:
            leaf = batch.column(3).to_numpy()
            times = np.array([parts.get(x, 0) for x in leaf.tolist()], np.int64)
            for block in range(times.max(initial=0)):
                part = batch.take(pa.array(np.flatnonzero(times > block)))
                shard = deal(part.column(0).to_numpy(), np.array([shards[x] for x in part.column(3).to_pylist()], np.int64))
                yield [part.column(3), shard.astype(np.int32), np.full(part.num_rows, block, np.int32), np.ones(part.num_rows, np.int32), part.column(0), part.column(1), np.zeros(part.num_rows), part.column(2)]

    def solve(batches):
        now, best, held = None, None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
            edges = np.append(np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])), batch.num_rows)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part, cell, kind = batch.slice(a, b - a), tuple(keys[:3, a]), keys[3, a]
                if cell != now:
                    if best is not None:
                        yield best.answers()
                    now, best, held = cell, None, []
                if kind == 0:
                    held.append(part)
                    continue
                if best is None and held:
                    asked = pa.concat_batches(held)
                    best, held = Best(asked.column(4).to_numpy(), asked.column(5).to_numpy(), dense(asked.column(7), width), asked.column(6).to_numpy(), k), []
                if best is not None:
                    best.offer(part.column(4).to_numpy(), part.column(5), dense(part.column(7), width))
        if best is not None:
            yield best.answers()

    cells = _CELL.format(element)
    both = map_arrow(visits, ask, cells).unionByName(map_arrow(rows, send, cells))
    keys = ["leaf", "shard", "block"]
    return map_arrow(both.repartition(*keys).sortWithinPartitions(*keys, "kind"), solve, _FOUND)


def nearest(vectors: DataFrame, queries_where: str, k: int = TOP, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that meets queries_where the k nearest other rows that are found.

    vectors(vec_id, embedding); score: Euclidean distance in doubles. Vectors that are null, zero, empty, or hold a
    component that is null or not finite take no part. Shorter vectors go on with zeros. Repeated rows and rows of one
    vec_id are rows of their own: each is a candidate for the others, and each that is a query has its own answers. A null
    vec_id is a candidate, last among ties. Ties go to the lesser vec_id; fewer than k others give as many rows. Which
    answers are missed depends on the vectors alone, not on how they are partitioned
    (but for rounding where two branches are equally near). An empty table gives no rows. Other
    columns, whatever their names, are not read. Squares have to fit a double: components beyond 1e150 don't.
    """
    plain = usable(vectors)
    element = plain.schema["v"].dataType.elementType.typeName()
    total, width = plain.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    nothing = plain.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    if not total:
        return nothing
    tree = fitted(plain, total, width)

    def assign(batches):
        for batch in batches:
            yield [*batch.columns, tree.leaf_of(dense(batch.column(2), width))]

    numbered = plain.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    rows = cut(map_arrow(numbered, assign, f"row long, vec_id long, v array<{element}>, leaf int"))
    n_rows = {r.leaf: r.n for r in rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a leaf
    asked = rows.where(queries_where)
    visits = calibrated(tree, asked, rows, width, k, recall)
    first = -(-visits // FIRST_WAVE)
    place = Window.partitionBy("query_row").orderBy("score", F.asc_nulls_last("vec_id"))

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    def wave(asked: DataFrame, span: tuple[int, int]) -> DataFrame:
        return _wave(asked, rows, tree, n_rows, width, span, span[1] == visits, k, element)

    found = cut(best(wave(asked.select("row", "vec_id", "v", F.lit(float("inf")).alias("bound")), (0, first))).drop("rank"))
    if visits > first:
        kth = found.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("most")).where(F.col("n") >= k)
        again = asked.join(kth, asked["row"] == kth["query_row"], "left").select("row", "vec_id", "v", F.coalesce("most", F.lit(float("inf"))).alias("bound"))
        found = found.unionByName(wave(again, (first, visits)))
    return best(found).select("query_id", "rank", "vec_id", "score")


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 12 over the whole embeddings table."""
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")

"""Exact top-k search by inner product: a Voronoi join of queries and data.

Bounded pivots cut space into cells, and queries and data are grouped by their nearest pivot. Of each cell only a summary
reaches the driver: count, radius, and the distances of the k + 1 vectors nearest to the pivot; of its queries count,
radius and greatest norm. For a group of queries the summaries give a score that the k-th best answer surely reaches, and
from it, for every cell, the least distance from its pivot at which a vector may still be an answer. Neighbouring groups
are joined to blocks of queries; a data vector is sent to the blocks that may need it, by its own distance, and to no
other. A block's data are dealt over shards, solved there by exact integer products, and the best of the shards merged.

Copies: a data vector goes to the blocks that need it, at most one for QUERY_BLOCK queries; a query goes to the shards of
its block, one for SHARD vectors. What the bounds don't prune has to meet, so these two sizes are all there is to choose.
The shards are solved in rounds, as many again in each as in all before: a query takes its k-th best score along, and a
shard returns only what is as good. So a query's partial answers grow with the logarithm of the shards, not with them.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import arrow_schema, cut, map_arrow, table

TOP, SCALE = 10, 1024
#: Pivots: the square root of the number of vectors within these bounds.
PIVOTS = (64, 1024)
#: Vectors of a shard, queries of a block.
SHARD, QUERY_BLOCK = 20_000, 50_000
#: Bound of the components that are pruned and multiplied in 64 bits; vectors beyond it are solved by exact wide integers.
MOST = 1 << 24


def scaled(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v array<int>, w array<double>): floor(SCALE * x) of every component, and a number for the row.

    v is null where a component's absolute value is MOST or more, and w where none is; a double holds the floor exactly.
    """
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    good = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    w = F.transform(F.transform(x, lambda c: c * SCALE), lambda c: F.when(F.abs(c) < 1 << 52, F.floor(c).cast("double")).otherwise(c))
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("embedding is not null").where(good)
    found = found.select("vec_id", w.alias("w"))
    wide = F.exists("w", lambda c: F.abs(c) >= MOST)
    return found.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.when(~wide, F.transform("w", lambda c: c.cast("int"))).alias("v"), F.when(wide, F.col("w")).alias("w"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers, padded with zeros or cut to width."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return lists.flatten().to_numpy().reshape(len(size), width).astype(np.float64)
    out = np.zeros((len(size), width))
    for i, x in enumerate(lists.to_pylist()):
        out[i, : len(x[:width])] = x[:width]
    return out


def least_distances(pivots: np.ndarray, cells: dict[int, tuple[int, float, list[float]]], groups: dict[int, tuple[int, float, float]], k: int) -> tuple[list[int], np.ndarray]:
    """(groups, least[group, cell]): how far from its pivot a vector of a cell has to be to be one of the k best answers.

    cells: (count, radius, least distances) by pivot; groups: (count, radius, greatest norm) by pivot. Infinity: none may.
    """
    norm, names = np.linalg.norm(pivots, axis=1), sorted(groups)
    at = np.array([j for j, (_, _, near) in cells.items() for _ in near], np.int64)
    near = np.array([d for _, _, ds in cells.values() for d in ds])
    full = np.full(len(pivots), False)
    full[list(cells)] = True
    out = np.full((len(names), len(pivots)), np.inf)
    for i, g in enumerate(names):
        _, radius, most = groups[g]
        product = pivots @ pivots[g]
        low = np.sort(product[at] - radius * norm[at] - most * near)
        sure = low[-(k + 1)] if len(low) > k else -np.inf  # one of them may be the query itself
        lack = sure - 1e-6 * (1 + abs(sure)) - product - radius * norm if np.isfinite(sure) else np.full(len(pivots), -np.inf)
        out[i] = np.where(lack <= 0, -1.0, lack / most * (1 - 1e-9) if most > 0 else np.inf)
    out[:, ~full] = np.inf
    return names, out


def blocks_of(names: list[int], groups: dict[int, tuple[int, float, float]], pivots: np.ndarray, least: np.ndarray, size: int) -> tuple[dict[int, tuple[int, int, int]], np.ndarray]:
    """((bundle, first block, blocks) by group, least[bundle, cell]): neighbouring small groups share a block of queries.

    Groups are taken in the order of the pivots' main direction; one of more than size queries has blocks of its own.
    """
    middle = pivots - pivots.mean(axis=0)
    along = middle @ np.linalg.svd(middle, full_matrices=False)[2][0] if len(pivots) > 1 else np.zeros(1)
    held, bundles, to, block = 0, [], {}, 0
    for i in sorted(range(len(names)), key=lambda i: along[names[i]]):
        n = groups[names[i]][0]
        if not bundles or held + n > size:
            block += max(1, -(-held // size)) if bundles else 0
            bundles.append([])
            held = 0
        bundles[-1].append(i)
        held += n
        to[names[i]] = (len(bundles) - 1, block, max(1, -(-n // size)))
    return to, np.array([least[b].min(axis=0) for b in bundles])


def _best(queries: np.ndarray, rows: np.ndarray, data: np.ndarray, others: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int):
    """(query's row, answer, score) of each query's k best of the data, ties to the lesser id, null ids last; exact at any size.

    Rows are numbered by rows and others; an answer is an index into the data. A score below 64 bits is null: it comes
    after all others. One above them is an error, as it is among the k best.
    """
    found = []
    most = queries.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0))
    exact, wide = most < 1 << 53, most >= 1 << 62
    if wide:
        queries, data = (np.array([[int(c) for c in v] for v in x.tolist()], object).reshape(x.shape) for x in (queries, data))
    step = 16 if wide else 256
    for a in range(0, len(rows), step):
        q = queries[a : a + step]
        block = (q @ data.T).astype(np.int64) if exact else q @ data.T if wide else q.astype(np.int64) @ data.astype(np.int64).T
        for name, score in zip(rows[a : a + step].tolist(), block, strict=True):
            own = np.flatnonzero(others != name)
            score = score[own]
            if wide:
                order = sorted(range(len(own)), key=lambda i: (-score[i], none[own[i]], ids[own[i]]))[:k]  # noqa: B023
                if order and score[order[0]] >= 1 << 63:
                    raise OverflowError(f"a score of vector {ids[own[order[0]]]} doesn't fit 64 bits")
                found += [(name, int(own[i]), score[i] if score[i] >= -(1 << 63) else None) for i in order]
                continue
            if len(score) > k:
                near = score >= np.partition(score, len(score) - k)[len(score) - k]
                score, own = score[near], own[near]
            order = np.lexsort((ids[own], none[own], -score))[:k]
            found.append((np.full(len(order), name), own[order], score[order]))
    if wide:
        return [list(c) for c in zip(*found, strict=True)] if found else [[], [], []]
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3


_NO_BOUND = -(1 << 63)
_FOUND = "query_row long, query_id long, vec_id long, score long"


def _solver(k: int):
    """Each query's best of a shard's rows; with a bound, what is at least that good."""
    kind = arrow_schema(_FOUND)

    def solve(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return kind.empty_table()
        lists = [t.column("v").combine_chunks() for t in (asked, rows)]
        width = max(pa.compute.max(x.value_lengths()).as_py() for x in lists)
        q, x = (_matrix(c, width) for c in lists)
        ids = rows.column("vec_id").combine_chunks()
        names = asked.column("row").to_numpy()
        found, answer, score = _best(q, names, x, rows.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), k)
        order = np.argsort(names)
        at = order[np.searchsorted(names, np.asarray(found, np.int64), sorter=order)]
        if "bound" in asked.column_names and len(at):
            least = asked.column("bound").to_numpy()[at]
            if isinstance(score, np.ndarray):
                good = np.flatnonzero(score >= least)
            else:  # wide: a score below 64 bits is null
                good = np.array([i for i, (s, b) in enumerate(zip(score, least.tolist(), strict=True)) if b == _NO_BOUND or s is not None and s >= b], np.int64)
            at, (found, answer, score) = at[good], ([x[i] for i in good.tolist()] if isinstance(x, list) else x[good] for x in (found, answer, score))
        return pa.table([pa.array(found, pa.int64()), asked.column("vec_id").combine_chunks().take(pa.array(at)), ids.take(pa.array(answer, pa.int64())), pa.array(score, pa.int64())], schema=kind)

    return solve


def _number(name: str, count: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(count)).cast("int")


def _wide(rows: DataFrame, queries_where: str, k: int) -> DataFrame:
    """_FOUND of the pairs with a wide vector on either side: each query's best of every shard, unpruned."""
    v = F.coalesce("w", F.transform("v", lambda c: c.cast("double")))
    every = rows.select("row", "vec_id", v.alias("v"), F.col("w").isNotNull().alias("wide"))
    asked = every.where(queries_where)
    n, m = every.count(), asked.count()
    shards, q_blocks = max(1, -(-n // SHARD)), max(1, -(-m // QUERY_BLOCK))
    # part 0: wide queries and all data; part 1: other queries and wide data
    sent = asked.select(F.when(F.col("wide"), 0).otherwise(1).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), _number("row", q_blocks).alias("block"), "row", "vec_id", "v")
    data = every.select(F.explode(F.when(F.col("wide"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("part"), _number("row", shards).alias("shard"), "row", "vec_id", "v")
    own = [F.col(c).alias(c) for c in ("row", "vec_id", "v")]  # columns of their own: those shared with the queries may be pruned
    data = data.select("part", "shard", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("block"), *own)
    keys = ["part", "shard", "block"]
    return sent.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(_solver(k), _FOUND)


def top_k(vectors: DataFrame, queries_where: str, k: int = TOP, n_pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that meets queries_where its k best other rows by inner product.

    vectors(vec_id, embedding). Vectors that are null, or hold a component that is null or not finite, take no part.
    Repeated rows and rows of one vec_id are rows of their own: each is a candidate for the others, and each that is a
    query has its own answers. A null vec_id is a candidate, last among ties. Vectors of different length are multiplied
    over the common part. Ties go to the lesser vec_id; fewer than k others give as many rows. An empty table gives no
    rows. Other columns, whatever their names, are not read. An answer whose score doesn't fit a long is an error.
    """
    rows = cut(scaled(vectors))
    found = _narrow(rows.where("v is not null").select("row", "vec_id", "v"), queries_where, k, n_pivots)
    if rows.where("w is not null").limit(1).count():
        found = found.unionByName(_wide(rows, queries_where, k))
    best = Window.partitionBy("query_row").orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("vec_id"))
    score = F.coalesce("score", F.raise_error(F.lit("a score doesn't fit 64 bits")).cast("long"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def _narrow(v: DataFrame, queries_where: str, k: int, n_pivots: int | None) -> DataFrame:
    """_FOUND of vectors within MOST: each query's best of every shard of the vectors that its block needs."""
    width, total = v.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.lit(1))).first()
    n_pivots = n_pivots or min(max(isqrt(total), PIVOTS[0]), PIVOTS[1])
    sample = v.orderBy(F.xxhash64("row"), "row").limit(n_pivots).collect()  # at most n_pivots rows
    nothing = v.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    if not sample:
        return nothing
    pivots = _matrix(pa.array([r.v for r in sample], pa.list_(pa.int32())), width)

    def assign(batches):
        square = (pivots**2).sum(axis=1)
        for batch in batches:
            x = _matrix(batch.column(2), width)
            own = (x**2).sum(axis=1)
            far = np.maximum(own[:, None] - 2 * x @ pivots.T + square, 0)
            cell = far.argmin(axis=1)
            yield [*batch.columns, cell.astype(np.int32), np.sqrt(far[np.arange(len(cell)), cell]), np.sqrt(own)]

    dealt = cut(map_arrow(v, assign, "row long, vec_id long, v array<int>, cell int, dist double, norm double"))
    ranked = dealt.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("dist", "row"))).where(F.col("n") <= k + 1)
    near = {r.cell: r.near for r in ranked.groupBy("cell").agg(F.collect_list("dist").alias("near")).collect()}  # k + 1 numbers a pivot
    cells = {r.cell: (r.n, r.r, near[r.cell]) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect()}
    asked = dealt.where(queries_where)
    groups = {r.cell: (r.n, r.r, r.most) for r in asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r"), F.max("norm").alias("most")).collect()}
    if not groups:
        return nothing
    names, least = least_distances(pivots, cells, groups, k)
    to, least = blocks_of(names, groups, pivots, least, QUERY_BLOCK)
    # (first block, blocks, shards) of each bundle; its shards by the cells of which it needs any vector
    spans = {b: (first, count) for b, first, count in to.values()}
    shards = {b: max(1, -(-sum(n for j, (n, r, _) in cells.items() if least[b, j] <= r) // SHARD)) for b in spans}

    def send(span):
        """Each vector to its shard of every block that may need it, if the shard is of the span."""

        def run(batches):
            for batch in batches:
                cell, dist, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 0))
                number = (row * 2654435761 & 0x7FFFFFFFFFFFFFFF) >> 16
                for b, (first, count) in spans.items():
                    shard = number % shards[b]
                    at = np.flatnonzero((dist >= least[b, cell]) & (shard >= span[0]) & (shard < span[1]))
                    if len(at):
                        part = batch.take(pa.array(at))
                        for block in range(first, first + count):
                            yield [np.full(len(at), block, np.int32), shard[at].astype(np.int32), *part.columns[:3]]

        return run

    def ask(span):
        """Each query to the shards of its block that are of the span."""

        def run(batches):
            for batch in batches:
                cell, row = batch.column(3).to_numpy(), batch.column(0).to_numpy()
                for g in np.unique(cell).tolist():
                    b, first, count = to[g]
                    at = np.flatnonzero(cell == g)
                    part = batch.take(pa.array(at))
                    block = first + ((row[at] * 2654435761 & 0x7FFFFFFFFFFFFFFF) >> 16) % count
                    for shard in range(span[0], min(span[1], shards[b])):
                        yield [block.astype(np.int32), np.full(len(at), shard, np.int32), *part.columns[:3], part.column("bound")]

        return run

    kind, keys = "block int, shard int, row long, vec_id long, v array<int>", ["block", "shard"]
    asked = asked.select("row", "vec_id", "v", "cell").withColumn("bound", F.lit(_NO_BOUND).cast("long"))
    found, done, most = None, 0, max(shards.values())
    while done < most:
        span = (done, max(1, 2 * done))
        part = map_arrow(asked, ask(span), f"{kind}, bound long").groupBy(*keys).cogroup(map_arrow(dealt, send(span), kind).groupBy(*keys)).applyInArrow(_solver(k), _FOUND)
        found = part if found is None else found.unionByName(part)
        done = span[1]
        if done < most:
            best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
            found = cut(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n"))
            kth = found.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select("query_row", "kth")
            asked = asked.drop("bound").join(kth, F.col("row") == F.col("query_row"), "left").select("row", "vec_id", "v", "cell", F.coalesce("kth", F.lit(_NO_BOUND)).alias("bound"))
    return found


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 6 over the whole embeddings table."""
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {TOP}
"""

"""Approximate nearest neighbours: exact where every leaf is visited, recall elsewhere."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import ann


def exact(rows, k=10, asked=lambda i: i is not None and i % 100 == 0):
    """rows (vec_id, vector); every row is a candidate for every other row."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    width = max((len(v) for _, v in rows), default=0)
    x = np.array([list(v) + [0.0] * (width - len(v)) for _, v in rows]).reshape(len(rows), width)
    out = []
    for n, (q, _) in enumerate(rows):
        if asked(q):
            far = np.sqrt(((x - x[n]) ** 2).sum(axis=1)).tolist()
            best = sorted((far[m], i is None, i or 0) for m, (i, _) in enumerate(rows) if m != n)[:k]
            out += [(q, rank, None if none else i, round(d, 9)) for rank, (d, none, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def answers(df):
    return sorted(((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in df.collect()), key=str)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("row", F.lit("x")).withColumn("leaf", F.lit(1)).withColumn("v", F.lit(2)).withColumn("bound", F.lit(0.5))


def clusters(n, copies=0):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * 0.05 + np.eye(8)[i % 4] * (1 + i % 3)).astype(np.float32).tolist()) for i in range(n)]
    return rows + [(10_000 + i, rows[0][1]) for i in range(copies)]


@pytest.mark.parametrize(("shard", "block", "wave"), [(100_000, 5_000, 8), (7, 2, 2), (50, 1, 1)])
def test_all_leaves_are_exact(spark, monkeypatch, shard, block, wave):
    """With every leaf visited the answers are those of brute force, whatever the shards, blocks and waves."""
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    monkeypatch.setattr(ann, "FIRST_WAVE", wave)
    rows = clusters(300, 40)
    assert answers(ann.nearest(frame(spark, rows).repartition(3), "vec_id % 50 = 0", recall=1.0)) == exact(rows, asked=lambda i: i % 50 == 0)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [3.0]), (6, []), (None, [1.0, 1.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.5]), (7, [-1.0, 0.5]), (100, [0.0, 0.0]), (200, [-1.0, 0.5, 4.0]), (300, [1.0, 1.0])]
    for kind in ("float", "double"):
        assert answers(ann.nearest(frame(spark, rows, kind), "vec_id % 100 = 0", recall=1.0)) == exact(rows)
    assert ann.nearest(frame(spark, rows).limit(0), "true").count() == 0
    assert ann.nearest(frame(spark, rows[:1]), "true").count() == 0
    assert ann.nearest(frame(spark, rows), "vec_id = 12345").count() == 0


def test_rows_of_one_id(spark):
    rows = [(100, [1.0]), (100, [2.0]), (5, [1.0]), (5, [9.0]), (6, [0.5]), (None, [9.0])]
    assert answers(ann.nearest(frame(spark, rows), "vec_id % 100 = 0", 3, recall=1.0)) == exact(rows, 3)


def test_copies_fill_the_answers(spark):
    """Far more copies than answers: ties by the lesser id, and every query has its k rows."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(500)] + [(1000 + i, [1.0 + i, 2.0, 3.0]) for i in range(1, 30)]
    assert answers(ann.nearest(frame(spark, rows), "vec_id % 100 = 0")) == exact(rows)


def test_enough_rows_whatever_the_leaves_hold(spark):
    rows = [(i, [float(i // 3), 1.0]) for i in range(60)]
    found = answers(ann.nearest(frame(spark, rows), "true", k=20, recall=0.0))
    assert len(found) == 60 * 20 and len({r[:2] for r in found}) == 60 * 20 and len({(r[0], r[2]) for r in found}) == 60 * 20


def test_recall_and_scores(spark, sf):
    """Of the table's true answers at least 0.9 are found; every score is the distance of the two vectors."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    by_id = {i: np.array(v) for i, v in rows}
    found = ann.op12_nearest(spark, sf).collect()
    true = exact(rows)
    assert len(found) == len(true) and {(r.query_id, r["rank"]) for r in found} == {r[:2] for r in true}
    assert len({(r.query_id, r.vec_id) for r in found} & {(q, i) for q, _, i, _ in true}) >= 0.9 * len(true)
    assert all(abs(r.score - np.sqrt(((by_id[r.query_id] - by_id[r.vec_id]) ** 2).sum())) < 1e-12 and r.query_id != r.vec_id for r in found)


def test_partitions_change_nothing(spark):
    rows = clusters(2000)
    results = [answers(ann.nearest(frame(spark, rows).repartition(n), "vec_id % 20 = 0")) for n in (1, 5)]
    assert results[0] == results[1]


def test_tree_and_its_visits():
    x = np.random.default_rng(2).normal(size=(500, 6))
    tree = ann.Tree(x, 40)
    leaf = tree.leaf_of(x)
    assert 20 <= tree.leaves <= 80 and set(leaf.tolist()) <= set(range(tree.leaves))
    for q, own in zip(x[:20], leaf[:20], strict=True):
        order = list(tree.visits(q))
        assert order[0] == own and sorted(order) == list(range(tree.leaves))
    assert ann.Tree(np.ones((50, 3)), 10).leaves == 1


def test_ragged_lists():
    lists = pa.array([[9.0], [1.0, 2.0], [], [3.0]], pa.list_(pa.float32())).slice(1)
    assert ann.dense(lists, 3).tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0]]

"""Connected components as a DataFrame program: alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, map_arrow

#: Edges that one local contraction holds at a time.
LOCAL_EDGES = 500_000


def _contract(batches):
    """Replaces the edges of each bounded block by stars around the least node of each local component."""

    def stars(us, vs):
        nodes, at = np.unique(np.concatenate([us, vs]), return_inverse=True)
        a, b = at[: len(us)], at[len(us) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        while (label[label] != label).any():
            label = label[label]
        other = label != np.arange(len(nodes))
        return [nodes[other], nodes[label[other]]]

    us, vs, held = [], [], 0
    for batch in batches:
        us.append(batch.column(0).to_numpy())
        vs.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held >= LOCAL_EDGES:
            yield stars(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [], [], 0
    if held:
        yield stars(np.concatenate(us), np.concatenate(vs))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with component the least node of each component, for the nodes of edges(u long, v long).

    Nulls take no part; loops and repeated edges are allowed; no edges give no rows. Each round contracts bounded
    blocks of edges locally, then hangs the neighbours of every node on the least of them (large star, then small
    star), until a round changes nothing. Hot nodes are met by a join on per-node minima, which are aggregated before
    the shuffle. State between rounds is checkpointed in the shared folder.
    """
    e = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    e = cut(map_arrow(e.select("u", "v"), _contract, "u long, v long").distinct())
    seen = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v")
        e = cut(map_arrow(small, _contract, "u long, v long").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

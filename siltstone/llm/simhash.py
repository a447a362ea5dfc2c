"""SimHash near-duplicate detection with pigeonhole blocks.

Fingerprints have 64 bits. They are split into BLOCKS blocks; two that differ in at most MAX_BITS bits agree in at least
BLOCKS - MAX_BITS blocks, so every choice of that many blocks is a key, and close pairs share a key. Keys are joined,
members of a key are verified by Hamming distance, and connected components of the links are the groups.

All work after the fingerprints is on distinct fingerprints, so copies cost nothing. Members of a key are compared in
cells of bounded size; a key with more members is dealt over a grid of cells (salt x salt), and no cell returns more links
than a spanning forest of its members, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import ASCII_LOWER, DOCUMENT_COLUMNS, cut, map_arrow, table
from siltstone.llm.components import connected_components
from siltstone.llm.near_copies import near_copies

SHINGLE, SEED, MAX_BITS, BLOCKS = 3, 42, 3, 6
#: Members of a cell; a key with more is dealt over several cells.
CELL = 2048
#: Groups up to this size are compared by shifts, larger ones by a search from member to member.
SMALL = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text: majority bits of the XXH64 of its word shingles; 0 without words."""
    tokens = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []
    if not tokens:
        return 0
    n = max(1, len(tokens) - shingle + 1)
    joined, size = b" ".join(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    end = end[-1:].tolist() if len(tokens) <= shingle else end[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start, end, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65_536):  # bounds the unpacked bits of a very long text
        part = hashes[k : k + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every row of docs(doc_id, text)."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield [batch.column(0), fps.view(np.int64)]

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def block_masks(bits: int = MAX_BITS, n_blocks: int = BLOCKS) -> list[int]:
    """A signed 64-bit mask for every choice of n_blocks - bits blocks."""
    edges = [round(i * 64 / n_blocks) for i in range(n_blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    masks = (sum(c) for c in combinations(parts, n_blocks - bits))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fp: np.ndarray, node: np.ndarray, bits: int):
    """Links of a spanning forest of one group, by search: every member is compared once with those not yet reached."""
    left = np.arange(len(fp))
    us, vs, queue = [], [], []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = np.bitwise_count(fp[left] ^ fp[at]) <= bits
        if near.any():
            found = left[near]
            us.append(np.full(len(found), node[at]))
            vs.append(node[found])
            queue.extend(found.tolist())
            left = left[~near]
    return us, vs


def _links(bits: int):
    """For batches (cell columns..., fp, node) sorted by cell: links within each cell."""

    def solve(same: np.ndarray, fp: np.ndarray, node: np.ndarray):
        first = np.flatnonzero(same)
        size = np.diff(np.append(first, len(fp)))
        of, sizes = np.repeat(np.arange(len(first)), size), np.repeat(size, size)
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        small = np.flatnonzero(sizes <= SMALL)
        g, f, n = of[small], fp[small], node[small]
        for shift in range(1, SMALL):
            if shift >= len(g):
                break
            hit = (g[shift:] == g[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= bits)
            if hit.any():
                us.append(n[:-shift][hit])
                vs.append(n[shift:][hit])
        for k in np.flatnonzero(size > SMALL):
            a, b = _forest(fp[first[k] : first[k] + size[k]], node[first[k] : first[k] + size[k]], bits)
            us += a
            vs += b
        return [np.concatenate(us), np.concatenate(vs)]

    def run(batches):
        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            keys = held[:-2]
            change = np.ones(len(held[-1]), bool)
            change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            last = np.flatnonzero(change)[-1]  # the last cell may go on in the next batch
            if last:
                yield solve(change[:last], held[-2][:last].view(np.uint64), held[-1][:last])
            held = [x[last:] for x in held]
        if held is not None and len(held[-1]):
            yield solve(np.arange(len(held[-1])) == 0, np.ascontiguousarray(held[-2]).view(np.uint64), held[-1])

    return run


def links(nodes: DataFrame, bits: int = MAX_BITS, n_blocks: int = BLOCKS) -> DataFrame:
    """Links (u, v) that connect whatever fingerprints of nodes(fp, node) are within bits bits; one row a fingerprint."""
    keyed = nodes.select("fp", "node", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(block_masks(bits, n_blocks))])).alias("b")).select("b.t", "b.k", "fp", "node")
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = keyed.join(sizes, ["t", "k"]).withColumn("m", F.ceil(F.col("n") / CELL).cast("int")).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    cells = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("t", "k", F.least("c", "j").alias("ci"), F.greatest("c", "j").alias("cj"), "fp", "node")
    cells = cells.repartition("t", "k", "ci", "cj").sortWithinPartitions("t", "k", "ci", "cj", "fp")
    return map_arrow(cells, _links(bits), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text).

    component_id is the least doc_id reachable over links of at most ``bits`` differing bits, itself included. Null and
    wordless texts have fingerprint 0, which links like any other. Repeated rows stay repeated; rows of one doc_id are one
    document. A null doc_id forms no links and has a null component_id. Texts may have any length. An empty table gives
    no rows. Other columns, whatever their names, are not read. The component is that of the row's fingerprint.
    """
    sig = cut(fingerprints(docs, shingle))
    nodes = cut(sig.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = connected_components(links(nodes, bits))
    of = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return sig.join(of, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 10 over the whole documents table."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near copies (five words, similarity 0.8) the document with the least doc_id stays.

    Rows with a null doc_id are in no class and all stay; so do all rows of a doc_id that stays. Null, empty and wordless
    texts are copies of one another.
    """
    ids = near_copies(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    kept = docs.join(ids, docs["doc_id"] == ids["_kept"], "left_semi").select(*DOCUMENT_COLUMNS)
    return kept.unionByName(docs.where("doc_id is null").select(*DOCUMENT_COLUMNS))

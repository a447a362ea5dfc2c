"""Near copies by similarity: SimHash blocks find candidates, Hamming distance thins them, shingle sets decide.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. Fingerprints
have 256 bits here, since that similarity is about one bit in seven, too far for 64 bits to tell from chance. Close pairs
share a block: a block is a choice of bits, and there are blocks enough that a pair at the threshold shares none of them
in at most MISSED of all cases. All blocks are cut from the same bits, so a pair with more differing bits misses all of
them together: the number of blocks follows from the share that misses them for each number of differing bits, weighed by
how often a pair has so many. Blocks get longer with the corpus, so that chance fills them with a few hundred texts at
most, and more in number, so that no more is missed (66 at 16 bits, 155 at 20, 369 at 24).

Members of a block are verified by Hamming distance, with a bound so wide that it loses next to nothing. The components of
these links are small; within each of them shingle sets are compared exactly, and the components of the exact links are
the classes. All work after the fingerprints is on distinct fingerprints; large blocks and large components are dealt
over grids of cells, and no cell returns more links than a few for each member.
"""

from __future__ import annotations

from math import acos, ceil, exp, lgamma, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import ASCII_LOWER, cut, map_arrow, mix, pair_hash
from siltstone.llm.components import connected_components

SHINGLE, SIMILARITY, LANES = 5, 0.8, 4
#: Share of the pairs at the threshold that share no block, at most.
MISSED = 0.03
#: Bits of a block, at least; members that chance gives a block are held to 2**SPARE by longer ones.
BLOCK_BITS, SPARE = 16, 8
#: Members of a cell of a block; bytes of the shingle sets of a cell of a component.
CELL, CELL_BYTES = 2048, 8_000_000
#: Texts of components that are looked up by a broadcast of their ids and fingerprints, at most; beyond it texts are shuffled.
FEW_MEMBERS = 200_000
#: Hot blocks or components whose cells are broadcast, at most; beyond it they are joined by shuffle.
FEW_HOT = 50_000
#: Groups up to this size are compared by shifts, larger ones in rows of a matrix.
SMALL = 16

_FP = [f"f{i}" for i in range(LANES)]
_FP_DDL = ", ".join(f"{c} long" for c in _FP)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct word shingles of a text, sorted; a text of fewer words is one shingle, one of none has none."""
    tokens = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []
    if len(tokens) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens))][: len(tokens)], np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    found = one
    for k in range(1, size):
        found = pair_hash(found[:-1], one[k:])
    return np.unique(found)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """64 * LANES majority bits of the hashes, as LANES numbers; zeros for none."""
    ones = np.zeros(64 * LANES, np.int64)
    for k in range(0, len(hashes), 8192):  # bounds the unpacked bits of a very long text
        part = hashes[k : k + 8192]
        lanes = np.stack([mix(part + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)) for lane in range(LANES)], axis=1)
        bits = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little")
        for a in range(0, len(bits), 255):  # counts that fit a byte
            ones += np.add.reduce(bits[a : a + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def agreement(similarity: float) -> float:
    """Share of the bits in which the fingerprints of two equally large sets of this Jaccard similarity agree."""
    return 1 - acos(2 * similarity / (1 + similarity)) / pi


def widest(similarity: float, bits: int) -> int:
    """The Hamming distance that pairs of this similarity exceed in one case of a thousand."""
    p = 1 - agreement(similarity)
    return ceil(bits * p + 3.1 * sqrt(bits * p * (1 - p)))


def missed(similarity: float, size: int, blocks: int) -> float:
    """Share of the pairs of this similarity that share none of so many blocks of size bits."""
    width, p = 64 * LANES, 1 - agreement(similarity)
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    total = 0.0
    for d in range(width + 1):  # differing bits
        shared = exp(choose(width - size, d) - choose(width, d)) if d <= width - size else 0.0
        total += exp(choose(width, d) + d * log(p) + (width - d) * log(1 - p)) * (1 - shared) ** blocks
    return total


def blocks_for(similarity: float, size: int) -> int:
    """The least number of blocks of size bits that misses at most MISSED."""
    low, high = 0, 1
    while missed(similarity, size, high) > MISSED:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if missed(similarity, size, middle) > MISSED else (low, middle)
    return high


def block_columns(n: int, similarity: float) -> list[np.ndarray]:
    """The bit numbers of each block, for n fingerprints: whole permutations of the bits, cut into blocks."""
    size = max(BLOCK_BITS, ceil(log2(max(n, 2))) - SPARE)
    tables, width = blocks_for(similarity, size), 64 * LANES
    rng, out = np.random.default_rng(7), []
    while len(out) < tables:
        order = rng.permutation(width)
        out += [order[a : a + size] for a in range(0, width - size + 1, size)]
    return out[:tables]


def _lanes(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy().view(np.uint64) for c in _FP], axis=1)


def _keys(columns: list[np.ndarray], whole: bool):
    """(key[, node, fingerprint]) of every block of every node."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                bits = np.unpackbits(np.ascontiguousarray(_lanes(part)).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
                key = np.concatenate([(t << 40) + bits[:, c] @ (1 << np.arange(len(c))) for t, c in enumerate(columns)])
                rest = pa.array(np.tile(np.arange(part.num_rows), len(columns)))
                yield [key, *([c.take(rest) for c in part.columns] if whole else [])]

    return run


def _grid(df: DataFrame, keys: list[str], hot: DataFrame, salt: str) -> DataFrame:
    """df with a cell: 0 but for the hot(keys, m), whose rows are dealt over a grid of m x m cells, each pair meeting in one."""
    hot = cut(hot)
    few = hot.count()
    if not few:
        return df.withColumn("cell", F.lit(0).cast("long"))
    both = df.join(F.broadcast(hot) if few <= FEW_HOT else hot, keys, "left").withColumn("m", F.coalesce("m", F.lit(1)))
    both = both.withColumn("c", F.pmod(F.xxhash64(salt), F.col("m"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    return both.withColumn("cell", F.least("c", "j") * F.col("m") + F.greatest("c", "j")).select(*df.columns, "cell")


def _groups(batches, n_keys: int):
    """The batches, sorted by their first columns, anew so that no group is split; with the place where each group begins."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.concat_batches([held, batch]) if held is not None else batch
        new = np.ones(held.num_rows, bool)
        new[1:] = np.logical_or.reduce([np.diff(held.column(i).to_numpy()) != 0 for i in range(n_keys)])
        first = np.flatnonzero(new)
        if first[-1]:
            yield held.slice(0, first[-1]), first[:-1]
            held = held.slice(first[-1])
    if held is not None:
        yield held, np.zeros(1, np.int64)


def _close(fp: np.ndarray, a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    return np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int64) <= bound


def _forest(size: int, near):
    """Links (a, b) of a spanning forest of members 0 to size; near(a, left) says which of left are linked to a."""
    left, queue, us, vs = np.arange(size), [], [], []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        if not len(left):
            break
        hit = near(at, left)
        if hit.any():
            us.append(np.full(int(hit.sum()), at))
            vs.append(left[hit])
            queue += left[hit].tolist()
            left = left[~hit]
    none = [np.empty(0, np.int64)]
    return np.concatenate(us or none), np.concatenate(vs or none)


def _matrix_links(fp: np.ndarray, bound: int, quick: int):
    """Links within one group: all close pairs where they are few, else a spanning forest."""
    us, vs, found = [], [], 0
    for a in range(0, len(fp), 256):
        hit = np.bitwise_count(fp[a : a + 256, None, 0] ^ fp[None, a:, 0]) <= quick
        u, v = np.nonzero(np.triu(hit, 1))
        u, v = u + a, v + a
        good = _close(fp, u, v, bound)
        us.append(u[good])
        vs.append(v[good])
        found += int(good.sum())
        if found > 8 * len(fp):
            return _forest(len(fp), lambda at, left: np.bitwise_count(fp[left] ^ fp[at]).sum(axis=1, dtype=np.int64) <= bound)
    return np.concatenate(us), np.concatenate(vs)


def _coarse(similarity: float):
    """Links by Hamming distance within the cells of (key, cell, node, fingerprint), sorted."""
    bound, quick = widest(similarity, 64 * LANES), widest(similarity, 64) + 4

    def run(batches):
        for held, first in _groups(batches, 2):
            fp, node = _lanes(held), held.column("node").to_numpy()
            size = np.diff(np.append(first, len(node)))
            of = np.repeat(np.arange(len(first)), size)
            small = np.flatnonzero((size > 1)[of] & (size <= SMALL)[of])
            g, f, n = of[small], fp[small], node[small]
            for shift in range(1, min(SMALL, len(g))):
                hit = np.flatnonzero((g[shift:] == g[:-shift]) & (np.bitwise_count(f[shift:, 0] ^ f[:-shift, 0]) <= quick))
                hit = hit[_close(f, hit, hit + shift, bound)]
                if len(hit):
                    yield [n[hit], n[hit + shift]]
            for k in np.flatnonzero(size > SMALL):
                own = slice(first[k], first[k] + size[k])
                u, v = _matrix_links(fp[own], bound, quick)
                if len(u):
                    yield [node[own][u], node[own][v]]

    return run


def alike(sets: list[np.ndarray], similarity: float):
    """Links (a, b) of a spanning forest of sets, by exact Jaccard similarity."""
    sizes = np.array([len(x) for x in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        good = both >= similarity * (sizes.sum() - both) - 1e-9
        return np.arange(good), np.arange(1, 1 + good)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    bound = np.append(0, np.cumsum(sizes))
    mark = np.zeros(int(ids.max(initial=0)) + 1, bool)

    def near(at, left):
        own = ids[bound[at] : bound[at + 1]]
        mark[own] = True
        out = np.append(0, np.cumsum(sizes[left]))
        hits = np.append(0, np.cumsum(mark[ids[np.repeat(bound[left] - out[:-1], sizes[left]) + np.arange(out[-1])]]))
        mark[own] = False
        both = hits[out[1:]] - hits[out[:-1]]
        return both >= similarity * (sizes[at] + sizes[left] - both) - 1e-9

    return _forest(len(sets), near)


def _exact(similarity: float):
    """Links by shingle sets within the cells of (component, cell, node, set), sorted."""

    def run(batches):
        for held, first in _groups(batches, 2):
            node, sets = held.column("node").to_numpy(), held.column("set")
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(node)], strict=True):
                if b - a > 1:
                    u, v = alike([np.frombuffer(sets[i].as_buffer(), np.uint64) for i in range(a, b)], similarity)
                    if len(u):
                        yield [node[a:b][u], node[a:b][v]]

    return run


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, component_id) for every row of docs(doc_id, text); component_id is the least doc_id of its near copies.

    Two texts are linked if the Jaccard similarity of their sets of word shingles (letters A-Z in lower case) is at least
    similarity; components of the links are classes. Null, empty and wordless texts are copies of one another; a text of
    fewer words than a shingle is one shingle. Repeated rows stay repeated; rows of one doc_id are one document. A null
    doc_id forms no links and has a null component_id. Texts may have any length. An empty table gives no rows. Other
    columns, whatever their names, are not read. Of the pairs at the threshold at most MISSED are not found, above it fewer.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sign(batches):
        for batch in batches:
            found = np.array([fingerprint(shingles(t.as_py(), shingle)) for t in batch.column(1)], np.uint64).reshape(-1, LANES)
            yield [batch.column(0), *np.ascontiguousarray(found.view(np.int64).T)]

    sig = cut(map_arrow(plain, sign, f"doc_id long, {_FP_DDL}"))
    nodes = cut(sig.where("doc_id is not null").groupBy(*_FP).agg(F.min("doc_id").alias("node")).select("node", *_FP))
    columns = block_columns(nodes.count(), similarity)
    hot = map_arrow(nodes, _keys(columns, False), "key long").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("m")).where("m > 1")
    cells = _grid(map_arrow(nodes, _keys(columns, True), f"key long, node long, {_FP_DDL}"), ["key"], hot, "f0").select("key", "cell", "node", *_FP)
    cells = cells.repartition("key", "cell").sortWithinPartitions("key", "cell")
    coarse = connected_components(map_arrow(cells, _coarse(similarity), "u long, v long"))

    members = cut(coarse.join(nodes, "node").select(F.col("node").alias("doc_id"), "component", *_FP))
    few = members.count() <= FEW_MEMBERS
    texts = plain.join(F.broadcast(members) if few else members, "doc_id").select("component", F.col("doc_id").alias("node"), "text", *_FP)

    def gather(batches):
        """The shingle sets of the texts that have the fingerprint they stand for."""
        for batch in batches:
            found = [shingles(t.as_py(), shingle) for t in batch.column("text")]
            own = np.array([fingerprint(x) for x in found], np.uint64).reshape(-1, LANES)
            at = np.flatnonzero((own == _lanes(batch)).all(axis=1)).tolist()
            yield [batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())), pa.array([found[i].tobytes() for i in at], pa.binary())]

    sets = cut(map_arrow(texts, gather, "component long, node long, set binary"))
    large = sets.groupBy("component").agg(F.ceil(F.sum(F.octet_length("set")) / CELL_BYTES).alias("m")).where("m > 1")
    dealt = _grid(sets, ["component"], large, "node").select("component", "cell", "node", "set")
    dealt = dealt.repartition("component", "cell").sortWithinPartitions("component", "cell", "node")
    classes = connected_components(map_arrow(dealt, _exact(similarity), "u long, v long"))
    of = nodes.join(classes, "node", "left").select(*_FP, F.coalesce("component", "node").alias("component_id"))
    return sig.join(of, _FP, "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))

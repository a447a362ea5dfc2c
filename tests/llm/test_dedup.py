"""Substring and near-duplicate removal against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import components, near_copies, simhash, substring_dedup
from tests.llm.conftest import TEXTS


def removed(docs):
    """Which words go, by comparing all windows."""
    docs = sorted(docs, key=lambda d: d[0])
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for i, t in docs}
    first = {}
    for i, _ in docs:
        for p in range(len(words[i]) - 19):
            first.setdefault(tuple(words[i][p : p + 20]), (i, p))
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] != (i, p):
                gone.update(range(p, p + 20))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def test_query_is_brute_force(spark, sf, texts):
    rows = substring_dedup.op1_substring_dedup(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == removed(list(texts.items()))


def test_small_blocks_agree(spark, sf, monkeypatch):
    whole = {r.doc_id: r.n_removed for r in substring_dedup.op1_substring_dedup(spark, sf).collect()}
    monkeypatch.setattr(substring_dedup, "BLOCK", 50)
    parts = substring_dedup.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet").repartition(7)).collect()
    assert {r.doc_id: r.n_removed for r in parts} == whole


def test_windows_are_told_apart_by_all_bits():
    """Windows whose first bits collide are still different ones, within a block and between blocks."""
    h, doc, slot, pos = np.zeros(6, np.uint64), np.array([1, 1, 2, 2, 3, 3]), np.array([0, 0, 0, 0, 9, 9]), np.array([0, 7, 0, 7, 0, 7], np.int32)
    more = np.array([5, 6, 5, 7, 6, 8], np.uint32)
    late = {(2, 0, 0), (3, 9, 0)}

    def settled(k):
        h_, place, more_ = substring_dedup._settle_windows(h[k], (doc[k], slot[k], pos[k]), more[k])
        return h_, *place, more_

    def places(rows):
        return set(zip(*(x.tolist() for x in substring_dedup._late(*rows)), strict=True))

    assert places(settled(slice(None))) == late
    assert places([np.concatenate(x) for x in zip(settled(slice(0, None, 2)), settled(slice(1, None, 2)), strict=True)]) == late


@pytest.mark.parametrize("a", range(26))
@pytest.mark.parametrize("gap", [0, 1, 5, 13, 26])
def test_windows_share_an_anchor(a, gap):
    """The cover: wherever two windows start, an aligned pair of anchors is within both."""
    n = 200
    found = set(substring_dedup.anchor_positions(n).tolist())
    assert any(a + k in found and a + gap + k in found for k in range(substring_dedup.PERIOD) if k + substring_dedup.ANCHOR <= substring_dedup.WINDOW)
    assert a in substring_dedup.windows_near(np.array([a + 12]), n) and a not in substring_dedup.windows_near(np.array([a + 13]), n)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1), st.integers(0, 2**31 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=50))
def test_blobs_round_trip(rows):
    h, doc, slot, pos, more = (np.array([r[k] for r in rows], kind) for k, kind in enumerate((np.uint64, np.int64, np.int64, np.int32, np.uint32)))
    _, blobs = substring_dedup.pack(h, (doc, slot, pos), more, 3)
    back = [x for b in blobs.to_pylist() for x in zip(*(c.tolist() for c in substring_dedup.unpack(b)), strict=True)]
    assert sorted(back) == sorted(rows)


PASSAGE = " ".join(f"p{i}" for i in range(20))


def test_texts_without_an_id_are_told_apart(spark):
    """A row loses only words that a repeated window of its own covers: the verdict's three rows, and more of them."""
    unique = " ".join(f"u{i}" for i in range(30))
    rows = [(None, PASSAGE), (None, f"a b c d e {PASSAGE}"), (None, unique)]
    got = {r.text: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[unique] == (30, 0) and sorted(got.values()) in ([(20, 0), (25, 20), (30, 0)], [(20, 20), (25, 0), (30, 0)])
    assert sum(n for _, n in got.values()) == 20


@pytest.mark.parametrize("few", [100_000, 0])
def test_texts_of_one_id_are_told_apart(spark, monkeypatch, few):
    """Texts that differ and share an id or have none: what brute force over texts, in their order, removes; copies stay alike."""
    monkeypatch.setattr(substring_dedup, "FEW_IDS", few)
    unique = [" ".join(f"u{k}x{i}" for i in range(30)) for k in range(6)]
    rows = [(7, PASSAGE), (7, f"x {PASSAGE} y"), (7, unique[0]), (3, f"{PASSAGE} three"), (3, unique[1]), (None, f"n {PASSAGE}"), (None, unique[2]), (None, f"{unique[3]} {PASSAGE}"), (9, unique[4]), (9, unique[4]), (8, f"{unique[5]} {unique[5]}"), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashed = {r.text or "": r.h for r in docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    texts = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    want = removed(list(enumerate(t for _, t in texts)))
    by_row = {r: want[k] for k, r in enumerate(texts)}
    got = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *by_row[i, t or ""]) for i, t in rows), key=str)
    assert sum(r.n_removed for r in got) == 4 * 20 + 30
    staged = substring_dedup.stage(spark, docs.selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars"), "")
    assert sorted((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in staged.collect() if r.doc_id is not None) == sorted((r.doc_id, r.kept) for r in got if r.doc_id is not None)


def test_odd_rows(odd, nothing):
    rows = substring_dedup.remove_repeats(odd).collect()
    got = {(r.doc_id, r.n_words, r.n_removed) for r in rows}
    assert len(rows) == odd.count()
    assert (1, 25, 0) in got and (2, 25, 25) in got and (3, 27, 24) in got  # of document 3 the first and last words stay
    assert {(4, 0, 0), (5, 0, 0), (6, 0, 0), (7, 1, 0), (None, 16, 0)} <= got
    assert [r.text for r in rows if r.doc_id == 3] == ["A note. tonight"]
    assert substring_dedup.remove_repeats(nothing).count() == 0
    assert substring_dedup.stage(odd.sparkSession, odd, "").columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert substring_dedup.stage(nothing.sparkSession, nothing, "").count() == 0


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, bits=3):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_simhash_is_brute_force(spark, sf, texts):
    fps = {i: fingerprint(t) for i, t in texts.items()}
    comp = groups(fps)
    rows = simhash.op10_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{f:016x}", comp[i]) for i, f in fps.items()}


def test_spark_hash_is_the_same(spark):
    """A shingle's hash is also what Spark's xxhash64 gives."""
    from pyspark.sql import functions as F

    for x in ("a b c", "é", ""):
        assert spark.range(1).select(F.xxhash64(F.lit(x))).first()[0] % 2**64 == xxhash.xxh64_intdigest(x.encode(), 42)


@pytest.mark.parametrize("cell", [4, 2048])
def test_links_of_close_fingerprints(spark, monkeypatch, cell):
    """Chains, dense groups and hot keys: components are those of all pairs, links at most a forest a cell."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {0: 0, 1: 7, 2: 15, 3: 2**63}
    for k, b in enumerate(base.tolist()):
        x = int(b)
        for j in range(1 + k % 9):
            x ^= int(sum(1 << int(p) for p in rng.integers(0, 64, 2)))
            fps[100 * (k + 1) + j] = x
    for j in range(60):  # one dense group
        fps[10_000 + j] = int(base[0]) ^ (1 << j) ^ (1 << ((j * 7) % 64))
    fps = {i: f for i, f in fps.items() if list(fps.values()).index(f) == list(fps).index(i)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f), i) for i, f in fps.items()], "fp long, node long")
    found = {r.node: r.component for r in components.connected_components(simhash.links(nodes)).collect()}
    assert {i: found.get(i, i) for i in fps} == groups(fps)


def test_simhash_odd_rows(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    comp = {r.doc_id: r.component_id for r in rows}
    assert comp[2] == 1 and comp[4] == comp[5] == comp[6] == 4 and comp[None] is None
    assert simhash.near_duplicates(nothing).count() == 0
    kept = [r.doc_id for r in simhash.stage(odd.sparkSession, odd, "").collect()]
    assert 2 not in kept and 1 in kept and 5 not in kept
    assert simhash.stage(odd.sparkSession, nothing, "").count() == 0
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(odd).collect()} == classes({i: t for i, t in TEXTS if i is not None}) | {None: None}


def test_simhash_stage_keeps_null_ids(odd):
    twice = odd.unionByName(odd.where("doc_id is null"))
    kept = [(r.doc_id, r.text) for r in simhash.stage(odd.sparkSession, twice, "").collect()]
    assert [t for i, t in kept if i is None] == [odd.where("doc_id is null").first().text] * 2
    assert {i for i, _ in kept} == {1, 4, 7, 8, 9, None}  # 3 shares 20 of 24 shingles with 1


def word_sets(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def similar(texts, least=0.8):
    """Pairs of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, by comparing all pairs that share any."""
    sets, inverted, common = word_sets(texts), {}, {}
    for i, x in sets.items():
        for g in x:
            inverted.setdefault(g, []).append(i)
    for own in inverted.values():
        for k, i in enumerate(own):
            for j in own[k + 1 :]:
                common[i, j] = common.get((i, j), 0) + 1
    found = {p for p, n in common.items() if n >= least * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    empty = [i for i, x in sets.items() if not x]
    return found | {(empty[0], i) for i in empty[1:]}


def classes(texts):
    up = {i: i for i in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in similar(texts):
        a, b = top(i), top(j)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in texts}


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_near_copies_are_brute_force(spark, size):
    docs = spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == classes({r.doc_id: r.text for r in docs.collect()})


@pytest.mark.parametrize(("cell", "cell_bytes"), [(2048, 8_000_000), (6, 3000)])
def test_edited_copies(spark, monkeypatch, cell, cell_bytes):
    """Copies with words replaced: all of the pairs at 0.8 or more are linked, none below; hot groups are dealt over cells."""
    monkeypatch.setattr(near_copies, "CELL", cell)
    monkeypatch.setattr(near_copies, "CELL_BYTES", cell_bytes)
    rng = np.random.default_rng(11)
    texts, i = {}, 0
    for length in (30, 100, 200, 400):
        for _ in range(30):
            words = [f"w{x}" for x in rng.integers(0, 5000, length)]
            for edits in range(0, 4):
                copy = list(words)
                for k in rng.integers(0, length, edits * max(1, length // 100)):
                    copy[k] = f"x{rng.integers(0, 10**9)}"
                texts[i] = " ".join(copy)
                i += 1
    base = [f"b{x}" for x in range(120)]
    for k in range(60):  # a dense group
        texts[i + k] = " ".join([*base[:k], f"n{k}", *base[k + 1 :]])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("f0", F.lit(1))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    pairs, found = similar(texts), classes(texts)
    assert all(got[k] == k or got[k] == got[found[k]] for k in got)
    assert np.mean([got[a] == got[b] for a, b in pairs]) > 0.99 and len(pairs) > 300
    assert all(found[k] == found[got[k]] for k in got)  # nothing that isn't linked shares a class


def test_blocks_grow_with_the_corpus():
    sizes = {n: (len(c[0]), len(c)) for n in (0, 10**4, 10**7, 10**9, 10**11) for c in [near_copies.block_columns(n, 0.8)]}
    assert [sizes[n][0] for n in sorted(sizes)] == [16, 16, 16, 22, 29]
    for size, count in sizes.values():
        assert near_copies.missed(0.8, size, count) <= near_copies.MISSED < near_copies.missed(0.8, size, count - 1)


@pytest.mark.parametrize("n", [10**4, 2**28, 2**32])
def test_missed_pairs_are_as_stated(n):
    """Simulated pairs at the threshold: no more than MISSED share no block, by the fingerprints themselves."""
    rng, columns = np.random.default_rng(n % 1000), near_copies.block_columns(n, 0.8)
    both, own = 240, 30  # 240 shared shingles of 270 each: similarity 0.8
    left = []
    for _ in range(1500):
        sets = rng.integers(0, 2**63, both + 2 * own, dtype=np.uint64)
        pair = [near_copies.fingerprint(np.concatenate([sets[:both], sets[both + k * own : both + (k + 1) * own]])) for k in (0, 1)]
        differ = np.unpackbits((pair[0] ^ pair[1]).view(np.uint8), bitorder="little")
        left.append(not any(not differ[c].any() for c in columns))
    assert np.mean(left) <= near_copies.MISSED + 0.005


def test_texts_are_found_with_and_without_a_broadcast(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    monkeypatch.setattr(near_copies, "FEW_MEMBERS", 0)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == whole


def test_components(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7), (None, 3), (500, 5)]
    rows = components.connected_components(spark.createDataFrame(path, "u long, v long")).collect()
    found = {r.node: r.component for r in rows}
    assert len(rows) == len(found) == 301 + 2 + 1 and found[300] == found[500] == 0 and found[1001] == 1000
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0

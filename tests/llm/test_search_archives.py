"""Exact search and WARC archives."""

import base64
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import knn, warc


def exact(rows, k=10, asked=lambda i: i is not None and i % 100 == 0):
    """rows: (vec_id, vector); every row is a candidate for every other row."""
    out = []
    for n, (q, v) in enumerate(rows):
        if asked(q):
            best = sorted((-sum(a * b for a, b in zip(v, x, strict=False)), i is None, i or 0) for m, (i, x) in enumerate(rows) if m != n)[:k]
            out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def answers(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x")).withColumn("v", F.lit(1)).withColumn("dist", F.lit(2))


@pytest.mark.parametrize(("shard", "block", "pivots"), [(20_000, 50_000, 64), (7, 2, 5)])
def test_clusters_ties_and_copies(spark, monkeypatch, shard, block, pivots):
    monkeypatch.setattr(knn, "SHARD", shard)
    monkeypatch.setattr(knn, "QUERY_BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * 0.05 + np.eye(8)[i % 4] * (1 + i % 3)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # copies: ties by id
    got = knn.top_k(frame(spark, rows), "vec_id % 100 = 0", n_pivots=pivots)
    assert answers(got) == exact([(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [3.0]), (6, []), (None, [1.0, 1.0]), (7, [-1.0, 0.5]), (7, [-1.0, 0.5]), (100, [0.0, 0.0])]
    got = answers(knn.top_k(frame(spark, rows), "vec_id % 100 = 0"))
    assert got == exact([(0, [1024, 2048]), (5, [3072]), (6, []), (None, [1024, 1024]), (7, [-1024, 512]), (7, [-1024, 512]), (100, [0, 0])])
    assert knn.top_k(frame(spark, rows).limit(0), "true").count() == 0
    assert knn.top_k(frame(spark, [(0, [1.0])]), "true").count() == 0


def test_wide_vectors(spark):
    """Components of any size: exact scores beyond 53 bits, and an error only where an answer leaves 64 bits."""
    rows = [(0, [20_000.0, 1.0]), (1, [1.0, 16_384.0]), (2, [-20_000.0, 3.0]), (3, [0.5, 0.25]), (100, [0.25, -2.0]), (4, [float(2**20), 0.5]), (200, [float(2**22) + 0.5, 1.0])]
    scaled = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows]
    for k in (10, 2):
        assert answers(knn.top_k(frame(spark, rows), "vec_id % 100 = 0", k)) == exact(scaled, k)
    assert answers(knn.top_k(frame(spark, rows[:3]), "vec_id = 0")) == exact(scaled[:3])
    huge = [(0, [1e30, 0.0]), (1, [0.0, 5.0]), (2, [-1e30, 0.0]), (3, [0.0, 7.0])]
    assert [r.vec_id for r in knn.top_k(frame(spark, huge), "vec_id = 0", 2).collect()] == [1, 3]
    for vectors, k in ((huge, 3), ([*huge, (4, [1.0, 1.0])], 1)):
        with pytest.raises(Exception, match="fit 64 bits"):
            knn.top_k(frame(spark, vectors), "vec_id = 0", k).collect()


def test_rows_of_one_id(spark):
    """Rows of one vec_id are candidates each, for one another too, and queries each."""
    rows = [(100, [1.0]), (100, [2.0]), (5, [1.0]), (5, [9.0]), (6, [0.5]), (None, [9.0])]
    assert answers(knn.top_k(frame(spark, rows), "vec_id % 100 = 0", 3)) == exact([(i, [int(1024 * x) for x in v]) for i, v in rows], 3)


def test_pruning_keeps_what_it_must():
    pivots = np.array([[10.0, 0.0], [-10.0, 0.0]])
    cells = {0: (100, 1.0, [0.1] * 11), 1: (100, 1.0, [0.1] * 11)}
    names, least = knn.least_distances(pivots, cells, {0: (3, 0.5, 10.5)}, 10)
    assert names == [0] and least[0, 0] < 0 and least[0, 1] > 1.0  # all of the near cell, nothing of the far one


def test_a_vector_goes_where_it_is_needed():
    """Of a cell only the vectors far enough from its pivot are sent; neighbouring groups share blocks, large ones are split."""
    rng = np.random.default_rng(3)
    pivots = np.array([[100.0, 0.0], [96.0, 0.0], [-50.0, 10.0], [90.0, 30.0]])
    data = np.concatenate([p + rng.normal(size=(200, 2)) * 2 for p in pivots])
    cell = ((data[:, None] - pivots) ** 2).sum(axis=2).argmin(axis=1)
    dist = np.sqrt(((data - pivots[cell]) ** 2).sum(axis=1))
    cells = {j: (int((cell == j).sum()), dist[cell == j].max(), np.sort(dist[cell == j])[:11].tolist()) for j in range(4)}
    for g in range(4):
        asked = np.flatnonzero(cell == g)
        names, least = knn.least_distances(pivots, cells, {g: (len(asked), dist[asked].max(), np.linalg.norm(data[asked], axis=1).max())}, 10)
        sent = dist >= least[0, cell]
        for q in asked:
            best = sorted((-(data[q] @ data[i]), i) for i in range(len(data)) if i != q)[:10]
            assert all(sent[i] for _, i in best)
        assert sent.sum() < len(data)
    groups = {0: (5, 1.0, 1.0), 1: (4, 1.0, 1.0), 2: (25, 1.0, 1.0), 3: (3, 1.0, 1.0)}
    to, bundled = knn.blocks_of([0, 1, 2, 3], groups, pivots, np.arange(16.0).reshape(4, 4), 10)
    blocks = {g: set(range(first, first + n)) for g, (_, first, n) in to.items()}
    assert len(blocks[2]) == 3 and not blocks[2] & (blocks[0] | blocks[1] | blocks[3])
    assert len(set.union(*blocks.values())) == max(set.union(*blocks.values())) + 1 and len(bundled) == 1 + max(b for b, _, _ in to.values())


def page_rows(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("size", F.lit(1)).withColumn("value", F.lit(2))


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:siltstone:page:99>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"


def test_archives(spark, tmp_path):
    rows = [(1, "http://a/", FAKE + "x"), (2, "http://b/\r\nWARC-Type: x", FAKE + "x"), (3, None, None), (4, "q", ""), (None, "q", "é"), (5, "z", "a\r\n\r\nb"), (6, "y", FAKE * 3), (7, "t", "é" * 10_000), (7, "t", "é" * 10_000), (8, "t", "WARC/1.0\r\n")]
    warc.write_warc(page_rows(spark, rows), str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w"), with_payload=True).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    by = {r.page_id: r for r in got}
    for i, _, text in rows:
        data = (text or "").encode()
        same = [j for j, _, t in rows if (t or "") == (text or "") and j is not None]
        keeper = max(same) if same else None
        r = by[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == keeper else ("revisit", keeper))
        assert r.payload == (data if r.record_type == "response" else b"")
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == len(rows)
    warc.write_warc(page_rows(spark, rows).limit(0), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_archives_are_bounded(spark, tmp_path, monkeypatch):
    """An archive holds the records of one task up to a number of bytes, or one record; digests are found by either join."""
    rows = [(i, f"http://a/{i}", "x" * (i * 37 % 900) + str(i % 9)) for i in range(60)] + [(100, "http://large/", "y" * 20_000)]
    want = None
    for few in (200_000, 0):
        monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
        monkeypatch.setattr(warc, "FEW_SHARED", few)
        at = tmp_path / str(few)
        warc.write_warc(page_rows(spark, rows).repartition(2), str(at))
        sizes = [len(warc.inflate(f.read_bytes())) for f in at.rglob("*.gz")]
        assert sorted(sizes)[-1] > 20_000 and sorted(sizes)[-2] < 4000 + 300 and 10 < len(sizes) < 40
        got = sorted((r.page_id, r.payload_bytes, r.record_type, str(r.refers_to)) for r in warc.read_warc(spark, str(at), whole=True).collect())
        assert len(got) == 61 and (want is None or got == want)
        want = got


def record(payload: bytes, page: int) -> bytes:
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:siltstone:page:%d>\r\nContent-Length: %d\r\n\r\n" % (page, len(payload)) + payload + b"\r\n\r\n"


def test_chains(spark, tmp_path):
    """Members of their own, records within payloads, and a broken chain."""
    inner = record(b"\r\n\r\nx", 50)
    good = [record(b"\r\n\r\na" + inner + inner, 1), record(b"\r\n\r\nb", 2)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, good)))
    (tmp_path / "b.warc").write_bytes(record(b"\r\n\r\nc", 3) + b"junk" + record(b"\r\n\r\nd", 4))
    (tmp_path / "c.warc").write_bytes(b"junk" + record(b"\r\n\r\ne", 5))
    got = warc.read_warc(spark, str(tmp_path), with_payload=True).collect()
    assert sorted((r.page_id, bytes(r.payload)[:1]) for r in got) == [(1, b"a"), (2, b"b"), (3, b"c")]


def test_long_headers(spark, tmp_path):
    """A header of any length; a chain that stops early is an error where the whole file is asked for."""
    rows = [(1, "data:" + "a" * 200_000, "x"), (2, "data:" + "WARC/1.0 " * 20_000 + "WARC/1.0", "y"), (3, "q", "z" + FAKE), (4, "r", "WARC/1.0\r\n" * 20_000)]
    warc.write_warc(page_rows(spark, rows).coalesce(1), str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w"), whole=True).collect()
    assert sorted((r.page_id, r.url) for r in got) == [(i, u) for i, u, _ in rows]
    (tmp_path / "b").mkdir()
    (tmp_path / "b/b.warc").write_bytes(record(b"\r\n\r\nc", 3) + b"junk")
    with pytest.raises(Exception, match="chain of records stops"):
        warc.read_warc(spark, str(tmp_path / "b"), whole=True).collect()


def test_reachable():
    offset = np.array([0, 5, 10, 12, 20])
    assert warc.reachable(offset, np.array([10, 12, 20, 20, 99])).tolist() == [True, False, True, False, True]
    assert warc.reachable(np.array([3]), np.array([9])).tolist() == [False] and len(warc.reachable(np.empty(0, int), np.empty(0, int))) == 0


def test_query(spark, sf):
    rows = warc.op4_warc(spark, sf).collect()
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in rows} == {(p.page_id, len((p.html or "").encode()), base64.b32encode(hashlib.sha1((p.html or "").encode()).digest()).decode()) for p in pages}

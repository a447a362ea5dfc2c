"""Queries over keys and groups larger than those of the smallest tables, against their SQL twins."""

import random
from collections import Counter
from datetime import date
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.functions import net, text
from siltstone.functions.phrases import phrase_lists
from siltstone.llm import packing
from siltstone.operators import keywords, ranks, term_trees
from siltstone.plans import catalog
from siltstone.sources import http
from siltstone.streaming import heartbeats


def against_twin(spark, folder, name, **tables):
    """The query's rows are those of its twin over the tables, written from DuckDB selects."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalog.queries()[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    plain = lambda rows: Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert plain(df.collect()) == plain(want) and want


@pytest.mark.parametrize("start", [65_530, 9_000_000, 2**31 - 20, 2**48 + 3])
def test_addresses_of_large_keys(spark, tmp_path, start):
    """A key beyond 16 bits takes several groups of an address; in one it made a text that is no address."""
    against_twin(spark, tmp_path, "ip_addresses", orders=f"SELECT CAST({start} + i AS BIGINT) AS o_orderkey FROM range(40) x(i)")


def test_families_of_large_sitemaps(spark, tmp_path):
    """All URLs of a sitemap count, those beyond the first 500 too."""
    pages = "SELECT CAST(i AS BIGINT) AS page_id, 'https://www.large.example/' || CASE WHEN i < 1500 THEN 'x' ELSE 'a-b-c-' || i END AS url, '' AS html FROM range(4500) x(i)"
    against_twin(spark, tmp_path, "sitemap_family_score", pages=pages)


def test_redirects_are_not_broadcast(spark):
    """Redirects made from a narrow column are estimated far too small; none of them goes through the driver."""
    links = spark.range(1000).selectExpr("concat('https://a.example/', id) AS src", "concat('https://a.example/', id + 1) AS dst")
    found = net.follow_redirects(links.selectExpr("src AS url"), links)
    assert {(r.hops, r.error) for r in found.where("url = 'https://a.example/0' OR url = 'https://a.example/998'").collect()} == {(5, "too_many_redirects"), (2, None)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_refusals_are_cheap():
    """A target that is never asked needs no opener, and answers go out in batches, not a batch each."""
    http._opener.cache_clear()
    rows = [http.fetch(f"http://10.0.0.{k % 250}/{k}") for k in range(2500)]
    assert http._opener.cache_info().currsize == 0 and {r["error"] for r in rows} == {"blocked_host"}
    assert [b.num_rows for b in http.answer_batches(rows)] == [1000, 1000, 500]
    assert len(list(http.answer_batches([{"url": "u", "body": b"x" * 3_000_000}] * 4))) == 2


def test_histories_by_pair(spark):
    """Draws in numpy are those of the expression; days that exist are left out pair by pair, without a row for each day."""
    seeds = [0, 1, 2**31, 2**32 - 1, 123456789]
    for k in (1, 3, 5000, 2**31 - 1):
        want = [r[0] for r in spark.createDataFrame([(s,) for s in seeds], "s long").coalesce(1).select(text.draw(F.col("s"), F.lit(k))).collect()]
        assert ranks._draws(np.array(seeds, np.uint64), k).tolist() == want
    pairs = spark.createDataFrame([(1, "a"), (2, None)], "pair int, k string")
    held = spark.createDataFrame([(1, date(2026, 9, 2)), (1, None), (3, date(2026, 9, 1))], "pair int, snapshot_date date")
    found = ranks.fill_snapshots(held, pairs, ["pair"], F.col("k"), F.lit(1), F.sequence(F.lit(date(2026, 9, 1)), F.lit(date(2026, 9, 3))))
    assert "LeftAnti" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert sorted((r.pair, r.snapshot_date.day) for r in rows) == [(1, 1), (1, 3), (2, 1), (2, 2), (2, 3)] and all(r.position is None for r in rows if r.pair == 2)


class Kept:
    """A state value and its handle, counting the messages that Spark would get."""

    def __init__(self):
        self.value, self.timers, self.messages = None, set(), 0

    def getValueState(self, *_):
        return self

    def get(self):
        self.messages += 1
        return self.value

    def update(self, value):
        self.messages, self.value = self.messages + 1, value

    def clear(self):
        self.messages, self.value = self.messages + 1, None

    def registerTimer(self, at):
        self.messages += 1
        self.timers.add(at)

    def fire(self, processor, passed):
        """The rows of all timers up to the watermark."""
        found, clock = [], SimpleNamespace(getCurrentWatermarkInMs=lambda: passed)
        for at in sorted(t for t in self.timers if t <= passed):
            self.timers.discard(at)
            found += [tuple(r) for part in processor.handleExpiredTimer((1,), clock, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)) for r in part.astype("int64").to_numpy().tolist()]
        return found


def test_many_beats_take_few_messages():
    """A key's state is read and written once a batch, whatever the number of its beats; before, once a beat."""
    kept, beats = Kept(), sorted(random.Random(1).sample(range(0, 10**9), 3000))
    owners = heartbeats.StaleOwners()
    owners.init(kept)
    for part in (beats[1::2], beats[::2]):
        assert not list(owners.handleInputRows((1,), iter([pd.DataFrame({"ms": part})]), None))
    passed = beats[2000] + 60_000
    found = kept.fire(owners, passed) + kept.fire(owners, 2 * 10**9)
    want = [b for b, after in zip(beats, [*beats[1:], 10**12], strict=True) if after > b + 120_000]
    assert [r[1] // 1000 for r in found] == want and kept.messages < 20 and kept.value is None


def test_sweeps_in_one_pass():
    """All due sweeps at once give what sweeping hour by hour does, sessions that end before they start included."""
    rng, hour = random.Random(2), heartbeats.HOUR_MS
    for _ in range(300):
        spans = sorted({(a := rng.randrange(40) * hour // 2, a + rng.randrange(-2, 8) * hour // 2) for _ in range(rng.randrange(1, 30))})
        passed, left, want = rng.randrange(45) * hour, spans, []
        for h in sorted({-(-e // hour) * hour for _, e in spans if -(-e // hour) * hour <= passed}):
            begun = [e for a, e in left if a <= h]
            left = [s for s in left if s[0] > h or s[1] > h]
            want += [(max(begun), h)] if begun and max(begun) <= h else []
        over, rest = heartbeats.swept(spans, passed)
        assert over == want and sorted(rest) == left


def test_packing_forgets_used_documents():
    """Lists without used documents give the same pieces, and get shorter; parts are cut once for tokens and words."""
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 400)) % 3000) for _ in range(300)])
    parts = packing.spaced_parts(texts)
    ids, bound = packing.tokenize(texts, packing.ranks_file(), parts)
    assert np.array_equal(ids, packing.tokenize(texts, packing.ranks_file())[0])
    whole, short = (packing.Bm25(*packing.word_numbers(texts, parts)) for _ in range(2))
    sizes = np.diff(bound).tolist()
    assert packing.pack_shard(sizes, short.scores, short.keep) == packing.pack_shard(sizes, whole.scores)
    assert len(short.docs) < len(whole.docs) / 2


def test_phrases_go_out_a_few_texts_at_a_time(spark, monkeypatch):
    """Counts by text, whatever the batch: a batch's phrases are not held at once."""
    rows = spark.createDataFrame([(i % 7, "red tea pot, red tea pot" if i % 5 else None) for i in range(1200)], "id int, text string").coalesce(1)
    found = keywords.phrase_counts(rows, "id", "text")
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in rows.collect()])
    assert [b.num_rows for b in keywords._counted([batch], "id", True, True)] == [2400, 2400, 960]
    assert {(r.term, r.n) for r in found.collect()} == {(t, 2) for t in ("red", "tea", "pot", "red tea", "tea pot", "red tea pot")}
    assert found.count() == 960 * 6


def shuffled_bytes(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_document_frequencies_shuffle_little(spark, tmp_path):
    """What is shuffled for term_document_frequency is not every phrase as a row, which made over five times the texts' size here."""
    rng = np.random.default_rng(5)
    words = np.array(["".join(rng.choice(list("aeioubdfgklmnprstvz"), rng.integers(3, 11))) for _ in range(5000)])
    texts = [" ".join(words[np.minimum(rng.zipf(1.2, 400), 5000) - 1]) for _ in range(400)]
    rows = pd.DataFrame({"doc_id": range(400), "source": [f"s{i % 3}" for i in range(400)], "text": texts})
    rows.to_parquet(tmp_path / "documents.parquet")
    before = shuffled_bytes(spark)
    found = catalog.queries()["term_document_frequency"](spark, str(tmp_path)).toPandas()
    assert shuffled_bytes(spark) - before < 3 * sum(map(len, texts))
    assert len(found) > 100_000 and found.df.sum() == sum(len(set(phrase_lists([t], False)[0].to_pylist())) for t in texts)


def test_doc_phrases_shuffle_no_phrases(spark, tmp_path):
    """Phrases of an id's only text aren't shuffled, which made several times the texts' size; a text or two more of an id change little."""
    words = [f"{a}{b}{c}" for a in ("tea", "pot", "leaf") for b in "aeiou" for c in ("lo", "mi", "ra", "tu")]
    texts = [" ".join(random.Random(i).choices(words, k=300)) for i in range(300)]
    for name, repeated in (("own", 0), ("shared", 20)):
        ids = [i if i >= repeated else i // 2 for i in range(300)]
        table = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        table.repartition(16).write.parquet(str(tmp_path / name / "documents.parquet"))  # files enough that the reader doesn't deal texts out
        before = shuffled_bytes(spark)
        found = catalog.queries()["doc_phrases"](spark, str(tmp_path / name)).toPandas()
        assert shuffled_bytes(spark) - before < sum(map(len, texts)) / 5
        assert len(found) > 100_000 and found.n.sum() == len(phrase_lists(texts)[0])


@pytest.mark.parametrize(("few", "united"), [(200_000, 1_000_000), (200_000, 400), (2, 1_000_000), (2, 400), (200_000, 0)])
def test_doc_phrases_of_repeated_ids(spark, tmp_path, monkeypatch, few, united):
    """Rows of one id, or of none, are counted together: few and many such ids, small and large ones, texts that end or begin oddly."""
    monkeypatch.setattr(keywords, "FEW_IDS", few)
    monkeypatch.setattr(keywords, "UNITED_BYTES", united)
    monkeypatch.setattr(term_trees, "BLOCK_CHARS", 300)
    rng = random.Random(3)
    ends = ["", " -", "- ", "'", "'s", "\u0301", "\u0338", "Σ", "x", "|", "\0", "."]
    words = "tea red pot's 12 of leaf it's green Σαςθ tea, tea".split()
    rows = [(rng.choice([*range(12), 7, 7, None]), rng.choice(ends) + " ".join(rng.choices(words, k=rng.randrange(1, 12))) + rng.choice(ends)) for _ in range(90)]
    rows += [(100 + i, "red tea pot, red tea pot") for i in range(9)] + [(100, None), (None, None), (200, None), (201, ""), (201, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = catalog.queries()["doc_phrases"](spark, str(tmp_path))
    want = Counter()
    for i, t in rows:
        want.update((i, term) for term in phrase_lists([t])[0].to_pylist())
    assert df.dtypes == [("doc_id", "bigint"), ("term", "string"), ("n", "bigint")]
    assert Counter({(r.doc_id, r.term): r.n for r in df.collect()}) == want and df.count() == len(want)


def test_doc_phrases_of_repeated_ids_are_the_twins(spark, tmp_path):
    """As above, with the rows of the SQL."""
    text = "'red tea pot ' || (i % 4) || ', green leaf ' || repeat('of tea ', CAST(i % 3 AS INT))"
    against_twin(spark, tmp_path, "doc_phrases", documents=f"SELECT CASE WHEN i % 5 > 0 THEN i // 2 END AS doc_id, CASE WHEN i % 11 > 0 THEN {text} END AS text FROM range(60) x(i)")


def test_long_texts_go_out_alone():
    """Phrases are held of a bounded number of bytes, but for the last text of a run."""
    size = [0, 1_500_000, 600_000, 5, 2_500_000, 0, 0, 1]
    assert list(keywords._held(pa.array(["x" * n or None for n in size]))) == [(0, 3), (3, 5), (5, 8)]


@pytest.mark.parametrize("inner", [False, True])
def test_document_frequencies_are_counts_of_texts(monkeypatch, inner):
    """Over blocks of a few texts, groups of any name or none, and phrases whose beginnings are none themselves."""
    rng = random.Random(8)
    words = "a of tea red pot's 12 é ab x9 the green leaf it's".split()
    rows = [{"source": rng.choice(["s", "", "a\n\1", None, "é"]), "text": rng.choice([None, "", *[" ".join(rng.choice([*words, "tea,", "- "]) for _ in range(rng.randrange(1, 30))) for _ in range(6)]])} for _ in range(300)]
    monkeypatch.setattr(term_trees, "BLOCK_CHARS", 500)
    batch = pa.RecordBatch.from_pylist(rows, pa.schema({"source": pa.string(), "text": pa.string()}))
    sent = pa.Table.from_batches(term_trees._sent([batch.slice(0, 97), batch.slice(97)], inner, True, 7))
    merged = [term_trees._merged(sent.filter(pa.array([b == k for b in sent["bucket"].to_pylist()])), "source") for k in set(sent["bucket"].to_pylist())]
    want = Counter((r["source"], t) for r in rows for t in set(phrase_lists([r["text"]], inner)[0].to_pylist()))
    found = [(r["source"], r["term"], r["df"]) for table in merged for r in table.to_pylist()]
    assert sent.num_rows > 50 and sorted(found, key=repr) == sorted(((*k, n) for k, n in want.items()), key=repr)


def test_document_frequencies_of_other_groups(spark):
    """Groups need not be texts, and there may be no phrase at all."""
    rows = spark.createDataFrame([(1, "red tea"), (None, "red tea"), (1, "tea"), (2, None)], "id int, text string")
    want = {(g, t, 1) for g in (1, None) for t in ("red", "red tea")} | {(None, "tea", 1), (1, "tea", 2)}
    assert set(map(tuple, term_trees.document_frequencies(rows, "id", "text").collect())) == want
    assert term_trees.document_frequencies(rows.where("id = 2"), "id", "text").collect() == []
    assert term_trees.document_frequencies(rows.limit(0), "id", "text").collect() == []

"""Stored tables, layouts, indexes, streams with timers, the HTTP source and further rules."""

import json
import random
import threading
import time
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.operators import issues, layout, ranks, reads, state, statistics, store, trigrams
from siltstone.plans import analogues as A
from siltstone.plans import catalog
from siltstone.sources import http_source
from siltstone.streaming import heartbeats, ingest

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- stores


def make(spark, path, kind, key, buckets=8):
    return store.Store(spark, str(path), tuple(key), StructType.fromDDL(kind), buckets)


def test_untouched_files_stay(spark, tmp_path):
    """An upsert rewrites the buckets of its keys; the files of all others keep their name and time."""
    pages = make(spark, tmp_path / "t", "url string, id long, title string", ["url"], 16)
    pages.apply(lambda held, rows: held.unionByName(rows), spark.range(200).selectExpr("'u' || id AS url", "id", "'old' AS title"))
    before = store.files(spark, pages.path)
    change = spark.createDataFrame([("u3", -1, "new"), ("u500", 500, "new")], "url string, id long, title string")
    touched = pages.apply(lambda held, rows: state.upsert(held, rows, ["url"]), change)
    after = store.files(spark, pages.path)
    assert 1 <= len(touched) <= 2
    of = lambda name: int(name.split("_bucket=")[1].split("/")[0])
    assert {n: t for n, t in before.items() if of(n) not in touched} == {n: t for n, t in after.items() if of(n) not in touched} and len(before) > 8
    assert not {n for n in before if of(n) in touched} & set(after)
    found = {r.url: (r.id, r.title) for r in pages.read().collect()}
    assert len(found) == 201 and found["u3"] == (3, "new") and found["u500"] == (500, "new") and found["u4"] == (4, "old")


def test_lookup_reads_its_buckets(spark, tmp_path):
    held = make(spark, tmp_path / "t", "k long, v long", ["k"], 16)
    held.apply(lambda old, rows: old.unionByName(rows), spark.range(500).selectExpr("id AS k", "id * 2 AS v"))
    found = held.matching(spark.createDataFrame([(7,), (9,), (7,), (1000,)], "k int"))
    assert rows_of(found) == [(7, 14), (9, 18)]
    assert "PartitionFilters: [isnotnull(_bucket" in found._jdf.queryExecution().toString() or "_bucket" in found._jdf.queryExecution().toString().split("PartitionFilters")[1][:200]


def test_buckets_can_become_empty(spark, tmp_path):
    held = make(spark, tmp_path / "t", "page_id long, code string", ["page_id"], 4)
    held.apply(lambda old, rows: old.unionByName(rows), spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "page_id long, code string"))
    none = spark.createDataFrame([], "page_id long, code string")
    held.apply(state.replace_issues, none, spark.createDataFrame([(1,), (2,)], "page_id long"))
    assert held.read().count() == 0 and held.apply(state.replace_issues, none, none.select("page_id")) == []


def test_store_limits(spark, tmp_path):
    with pytest.raises(ValueError, match="buckets"):
        make(spark, tmp_path / "t", "k long", ["k"], 0)
    held = make(spark, tmp_path / "t", "k long", ["k"], 64)
    assert held.read().count() == 0
    with pytest.raises(ValueError, match="own keys"):
        held.apply(lambda old, rows: spark.range(300).select(F.col("id").alias("k")), spark.createDataFrame([(1,)], "k long"))


def test_null_keys_and_repeated_changes(spark, tmp_path):
    held = make(spark, tmp_path / "t", "k long, captured_at timestamp, position int", ["k"])
    t = datetime(2026, 10, 1)
    batches = [[(1, t, 5), (None, t, 1)], [(1, t, 3), (2, t, None)], [(1, t - timedelta(1), 9), (2, t, 4), (None, t + timedelta(1), None)]]
    for batch in [*batches, *batches[::-1]]:
        store.keep_latest(held, spark.createDataFrame(batch, "k long, captured_at timestamp, position int"))
    assert {r.k: (r.captured_at, r.position) for r in held.read().collect()} == {1: (t, 3), 2: (t, 4), None: (t + timedelta(1), None)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_latest_kept_after_any_split(spark, tmp_path, seed):
    """However captures are split into batches, repeated and ordered, the kept positions are those of the whole history."""
    rng = random.Random(seed)
    t = datetime(2026, 10, 1)
    shots = [(rng.randrange(12), t + timedelta(hours=rng.randrange(40)), rng.choice([None, *range(1, 9)])) for _ in range(120)]
    kind = "k long, captured_at timestamp, position int"
    held, left = make(spark, tmp_path / "t", kind, ["k"], 4), shots[:]
    while left:
        n = rng.randrange(1, 60)
        store.keep_latest(held, spark.createDataFrame(left[:n] + rng.sample(shots, 3), kind))
        left = left[n:]
    whole = spark.createDataFrame(shots, kind)
    want = ranks.latest_positions(whole.select("k").distinct(), whole, "UTC", ["k"])
    got = held.read().select("k", "position", F.date_format("captured_at", "yyyy-MM-dd").alias("date"))
    assert rows_of(got) == rows_of(want)


# --- streams


def run(spark, tmp_path, batches, kind, build, per=None):
    """The rows of a stream over batches, each read by its own micro-batch."""
    before = spark.conf.get(heartbeats.STATE_STORE[0])
    spark.conf.set(*heartbeats.STATE_STORE)
    out = []
    try:
        for rows in batches:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
            build(stream).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(heartbeats.STATE_STORE[0], before)
    return out


T0 = datetime(2026, 10, 7)


def beats(rng, users=4, n=50):
    return [(u, T0 + timedelta(seconds=30 * i)) for u in range(users) for i in range(n) if rng.random() < 0.3] + [(99, T0 + timedelta(hours=2))]


@pytest.mark.parametrize("parts", [1, 3])
def test_stale_owners(spark, tmp_path, parts):
    """The same silences are found in one batch and in several, with beats that come late, twice or without an owner."""
    rows = beats(random.Random(7))
    late = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=60 * (r[0] % 3)), r[0]))
    size = -(-len(late) // parts)
    batches = [late[i * size : (i + 1) * size] for i in range(parts)]
    batches[-1] = [*batches[-1], late[-2], (None, T0)]
    got = run(spark, tmp_path, batches, "user int, at timestamp", lambda s: heartbeats.stale_owners(s, "user", "at"))
    limit, passed = timedelta(minutes=2), max(r[1] for r in rows) - timedelta(minutes=10)
    want = sorted((u, a, a + limit) for u, a in rows if a + limit <= passed and not any(v == u and a < b <= a + limit for v, b in rows))
    assert sorted(map(tuple, got)) == want and len(want) > 10


@pytest.mark.parametrize("parts", [1, 4])
def test_ended_sessions(spark, tmp_path, parts):
    """A session is swept at the first full hour after its end; renewals move it, and it can start again."""
    h = lambda x: T0 + timedelta(hours=x)
    rows = [("a", h(0), h(2.5)), ("a", h(2), h(4)), ("a", h(6), h(6.5)), ("b", h(0), h(1)), ("b", h(0.9), h(1)), ("c", h(1), h(9)), ("d", h(3), h(3.2)), ("d", h(3.1), h(3.1)), (None, h(1), h(2)), ("e", h(1), None), ("z", h(8), h(20))]
    rows.sort(key=lambda r: r[1])
    size = -(-len(rows) // parts)
    got = run(spark, tmp_path, [rows[i * size : (i + 1) * size] for i in range(parts)], "id string, at timestamp, ends timestamp", lambda s: heartbeats.ended_sessions(s, "id", "at", "ends"))
    assert sorted(map(tuple, got)) == [("a", h(4), h(4)), ("a", h(6.5), h(7)), ("b", h(1), h(1)), ("d", h(3.2), h(4))]


def test_ingest_of_late_and_repeated_batches(spark, tmp_path):
    """Unknown pairs are left out; a day's first capture counts; a batch that comes again changes nothing; too late is too late."""
    kind = "k long, captured_at timestamp, position int"
    daily = make(spark, tmp_path / "daily", "k long, snapshot_date date, captured_at timestamp, position int", ["k"], 4)
    latest = make(spark, tmp_path / "latest", kind, ["k"], 4)
    pairs = spark.createDataFrame([(1,), (2,)], "k long")
    h = lambda x: T0 + timedelta(hours=x)
    first, second = [(1, h(5), 7), (1, h(5), 7), (2, h(6), None), (9, h(7), 1)], [(1, h(3), 4), (1, h(30), 2), (2, h(6), None), (2, h(31), 8)]
    for batch in (first, second, first + second, [(1, h(1), 1), (2, h(32), 5)]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        ingest.ingest(stream, pairs, daily, str(tmp_path / "state"), latest).trigger(availableNow=True).start().awaitTermination()
    day = lambda n: (T0 + timedelta(n)).date()
    assert rows_of(daily.read()) == sorted([(1, day(0), h(3), 4), (1, day(1), h(30), 2), (2, day(0), h(6), None), (2, day(1), h(31), 8)], key=str)
    assert rows_of(latest.read()) == [(1, h(30), 2), (2, h(32), 5)]
    again = spark.createDataFrame(first + second, kind).where("k < 9").withColumn("snapshot_date", F.to_date("captured_at"))
    before = rows_of(daily.read())
    ingest.into(daily, latest)(again, 3)  # a batch that is tried again
    assert rows_of(daily.read()) == before


# --- layout and index


@pytest.fixture(scope="module")
def tables(spark):
    return A.with_signs(A.read_tables(spark, DATA))


def test_layout_gives_the_list(spark, tables, tmp_path):
    layout.write_layout(tables, "lists", str(tmp_path))
    try:
        owners = [r.user_id for r in tables.clients.select("user_id").distinct().collect()][:2]
        for owner, kw in ((owners[0], {}), (owners[1], {"page": 2, "page_size": 7}), (owners[0], {"page": 500}), (owners[0], {"q": "%"}), (owners[1], {"q": "urgent", "page_size": 3}), (-1, {})):
            got = layout.list_pages(spark, "lists", owner, "America/Toronto", **kw)
            want = reads.list_pages(tables, owner, "America/Toronto", **kw)
            assert got.columns == want.columns and [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
        first = layout.list_pages(spark, "lists", owners[0], "UTC", page_size=5).collect()
        held = spark.table("lists_pages").where(F.col("id") == first[-1].id).first()
        after = layout.list_pages(spark, "lists", owners[0], "UTC", page_size=5, after=tuple(held[c] for c in reads.ORDER))
        assert [r.id for r in after.collect()] == [r.id for r in layout.list_pages(spark, "lists", owners[0], "UTC", page=2, page_size=5).collect()]
        with pytest.raises(ValueError, match="page starts at 1"):
            layout.list_pages(spark, "lists", owners[0], "UTC", page=0)
    finally:
        layout.drop_layout(spark, "lists")


def test_layout_moves_no_pairs(spark, tables, tmp_path):
    """The plan of a list looks the rows of its pages up by id, shuffles nothing, and sorts within one partition."""
    layout.write_layout(tables, "planned", str(tmp_path))
    try:
        plan = layout.list_pages(spark, "planned", 3, "UTC")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan, plan
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Filter (page_id" in plan
        pairs = spark.table("planned_pairs").withColumn("f", F.input_file_name())
        assert pairs.select("f").distinct().count() == layout.BUCKETS and pairs.count() == tables.page_keywords.select("page_id").distinct().count()
    finally:
        layout.drop_layout(spark, "planned")


TEXTS = [(1, "Green Tea"), (2, "100% cotton"), (3, "a_b"), (4, "ab"), (5, ""), (6, None), (7, "ÉTÉ à Paris"), (8, "green"), (9, "tea\tgreen tea"), (9, "Tea"), (10, "😀😀 tea"), (11, "aaaaaa")]


@pytest.mark.parametrize("q", ["tea", "GREEN TEA", "%", "_", "a_", "ab", "", "é", "été", "100% c", "😀", "😀 t", "aaaa", "aaaaaaa", "zzz", "n tea", "\t"])
def test_search_is_a_scan(spark, tmp_path, q):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    index = trigrams.build(texts, str(tmp_path / "i"))
    assert rows_of(trigrams.search(index, q)) == sorted(((i, t) for i, t in TEXTS if t is not None and q.lower() in t.lower()), key=str)


def test_search_of_many_and_none(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "FEW", 3)
    texts = spark.range(50).selectExpr("id", "'page ' || id AS text")
    index = trigrams.build(texts, str(tmp_path / "i"))
    assert trigrams.search(index, "page").count() == 50 and trigrams.search(index, "page 7").count() == 1
    with pytest.raises(ValueError, match="200 characters"):
        trigrams.search(index, "x" * 201)
    empty = trigrams.build(texts.limit(0), str(tmp_path / "e"))
    assert trigrams.search(empty, "page").count() == 0 and trigrams.search(empty, "").count() == 0
    index.remove()
    assert not (tmp_path / "i").exists()


def test_searched_lists(spark, tables, tmp_path):
    index = trigrams.index_pages(tables, str(tmp_path / "i"))
    for q in (None, " Urgent ", "%"):
        got = trigrams.list_pages(tables, index, 3, "UTC", q)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in reads.list_pages(tables, 3, "UTC", q=q).collect()]


# --- statistics and rules


def test_statistics(spark):
    spark.range(7).selectExpr("id AS page_keyword_id", "CASE WHEN id < 5 THEN id % 2 END AS position").write.mode("overwrite").saveAsTable("stored_snapshots")
    try:
        assert statistics.table_rows(spark, "stored_snapshots") is None
        before = spark.conf.get(statistics.NDV_ERROR)
        statistics.refresh(spark, "stored_snapshots", 0.04)
        assert spark.conf.get(statistics.NDV_ERROR) == before
        assert rows_of(statistics.column_statistics(spark, "stored_snapshots")) == [("page_keyword_id", 7, 0, 7, "0", "6"), ("position", 7, 2, 2, "0", "1")]
    finally:
        spark.sql("DROP TABLE stored_snapshots")


def test_further_rules(spark):
    kind = "page_id long, site string, url string, title string, meta_description string, h1s array<string>, headings array<string>, canonical string, robots string, images_total int, images_missing_alt array<string>, insecure_resources int, script_count int, word_count int, price int"
    facts = spark.createDataFrame([(1, "s", "https://s/", None, "d", ["h"], [], "https://s/", "", 0, [], 0, 0, 900, 3), (2, "s", "https://s/2", "A title that is of a length that is good", "d", ["h"], [], "https://s/2", "", 0, [], 0, 0, 900, None)], kind)
    cheap = issues.Rule("cheap", "notice", F.col("price") < 5, F.format_string("costs %d", F.col("price")), F.struct("price", "title_count"))
    assert rows_of(issues.find_issues(facts, more=[cheap], without=["title_missing"])) == [(1, "cheap", "notice", "costs 3", '{"price":3,"title_count":0}')]
    swapped = issues.Rule("title_missing", "error", F.col("title").isNull(), "No title")
    assert rows_of(issues.find_issues(facts, more=[swapped], without=["title_missing"])) == [(1, "title_missing", "error", "No title", None)]
    for kw in ({"more": [swapped]}, {"without": ["unheard_of"]}, {"more": [cheap, cheap]}):
        with pytest.raises(ValueError):
            issues.find_issues(facts, **kw)
    with pytest.raises(ValueError, match="severities"):
        issues.Rule("x", "loud", F.lit(True), "y")


def test_codes_are_those_of_the_rules(spark):
    row = spark.range(1).select(F.lit(True).alias("x"))
    assert len(issues.CODES) == len(issues.rules()) == 13 and row.count() == 1


# --- HTTP as a source


class Host(BaseHTTPRequestHandler):
    asked: list = []
    busy = 0

    def do_GET(self):
        Host.asked.append((self.path, time.monotonic()))
        if self.path == "/busy" and Host.busy < 1:
            Host.busy += 1
            self.send_response(503)
            self.end_headers()
            return
        body = b"<urlset>" + b"".join(b"<url><loc>https://a.example/%d</loc></url>" % i for i in range(30)) + b"</urlset>" if self.path.endswith(".xml") else b"<html><title>T</title></html>"
        self.send_response(404 if self.path == "/gone" else 200)
        self.send_header("Content-Type", "application/xml" if self.path.endswith(".xml") else "text/html")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Host)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_as_a_source(spark, base, tmp_path):
    http_source.register(spark)
    urls = [f"{base}/{p}" for p in ("a", "b", "busy", "gone")] + ["ftp://x.example/", "http://127.0.0.1:1/"]
    options = {"allowPrivate": "true", "delayMs": "0", "baseDelayMs": "1"}
    few = spark.read.format("http_pages").options(urls=json.dumps([*urls, urls[0]]), **options).load()
    got = {r.url: (r.status, r.error, bytes(r.body) if r.body else None) for r in few.collect()}
    page = b"<html><title>T</title></html>"
    want = {urls[0]: (200, None, page), urls[1]: (200, None, page), urls[2]: (200, None, page), urls[3]: (404, None, page), urls[4]: (None, "invalid_url", None), urls[5]: (None, "site_unreachable", None)}
    assert got == want and Host.busy == 1
    http_source.write_url_list(spark.createDataFrame([(u,) for u in [*urls, urls[0], None]], "url string"), str(tmp_path / "list"), 3)
    listed = spark.read.format("http_pages").options(list=f"file://{tmp_path}/list", **options).load()
    assert {r.url: (r.status, r.error, bytes(r.body) if r.body else None) for r in listed.collect()} == want and listed.rdd.getNumPartitions() <= 3
    assert rows_of(few.where("status = 404").select("url")) == [(urls[3],)]


def test_a_host_is_asked_with_pauses_by_one_task(spark, base, tmp_path):
    """The URLs of a host lie in one file, hosts in turns, and a pause is between two requests to a host."""
    http_source.register(spark)
    urls = spark.createDataFrame([(f"{base}/p{i}",) for i in range(4)] + [(f"http://no{i % 2}.example:81/{i}",) for i in range(6)], "url string")
    http_source.write_url_list(urls, str(tmp_path / "list"), 2)
    by_file = urls.sparkSession.read.parquet(str(tmp_path / "list")).withColumn("f", F.input_file_name()).withColumn("host", F.regexp_extract("url", "//([^:/]+)", 1))
    assert by_file.groupBy("host").agg(F.count_distinct("f").alias("n")).where("n > 1").count() == 0
    Host.asked.clear()
    spark.read.format("http_pages").options(urls=json.dumps([f"{base}/p{i}" for i in range(4)]), allowPrivate="true", delayMs="150").load().collect()
    times = [t for p, t in Host.asked if p.startswith("/p")]
    assert len(times) == 4 and all(b - a >= 0.14 for a, b in zip(times, times[1:], strict=False))


def test_sitemaps_as_a_source(spark, base, tmp_path):
    http_source.register(spark)
    http_source.write_url_list(spark.createDataFrame([("s", f"{base}/map.xml"), ("s", f"{base}/gone"), ("t", f"{base}/map.xml")], "site string, url string"), str(tmp_path / "list"))
    found = spark.read.format("http_sitemaps").options(list=str(tmp_path / "list"), most="5", allowPrivate="true", delayMs="0").load()
    assert rows_of(found.groupBy("site", "sitemap_url", "kind").agg(F.count("loc"), F.max("ord"))) == [("s", f"{base}/map.xml", "urlset", 5, 4), ("t", f"{base}/map.xml", "urlset", 5, 4)]


def test_source_options(spark, tmp_path):
    http_source.register(spark)
    for options, said in (({}, "one of the options"), ({"urls": "[]", "list": "x"}, "one of the options"), ({"list": str(tmp_path / "none")}, "none")):
        with pytest.raises(Exception, match=said):
            spark.read.format("http_pages").options(**options).load().collect()
    assert spark.read.format("http_pages").options(urls="[]").load().count() == 0
    assert "page_title" in catalog.queries()

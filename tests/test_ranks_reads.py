"""Rank history, reads, state and discovery on small fixtures."""

import hashlib
import math
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from siltstone.operators import discovery, ranks, reads, state
from siltstone.sources.schema import SCHEMAS
from tests.test_text_urls import draws, fnv

ZONE = "America/Toronto"


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def shots(spark, *rows):
    return spark.createDataFrame([(p, at(t), x) for p, t, x in rows], "pair int, captured_at timestamp, position int")


def test_history_days_and_dst(spark):
    pairs = spark.createDataFrame([(1, "a"), (2, "b")], "pair int, term string")
    s = shots(spark, (1, "2026-10-07T02:30:00", 5), (1, "2026-11-01T03:30:00", 4), (1, "2026-11-02T04:30:00", None), (1, "2026-11-03T05:30:00", 6))
    h = lambda a, b: [(r.date, r.position) for r in ranks.page_history(pairs, s, ["pair"], ZONE, a, b).orderBy("captured_at").collect()]
    assert h("2026-10-07", "2026-10-07") == []
    assert h("2026-10-31", "2026-11-03") == [("2026-10-31", 4), ("2026-11-01", None), ("2026-11-03", 6)]
    series = {r.pair: r.points for r in ranks.history_series(pairs, ranks.page_history(pairs, s, ["pair"], ZONE, "2026-10-31", "2026-11-03"), ["pair"]).collect()}
    assert [p.date for p in series[1]] == ["2026-10-31", "2026-11-01", "2026-11-03"] and series[2] == []
    wide = ranks.history_pivot(ranks.page_history(pairs, s, ["pair"], ZONE, "2026-10-31", "2026-11-03"), "term", ["a", "b"]).orderBy("date").collect()
    assert [(r.date, r.a, r.b) for r in wide] == [("2026-10-31", 4, None), ("2026-11-01", None, None), ("2026-11-03", 6, None)]


def test_latest_and_tone(spark):
    pairs = spark.createDataFrame([(1,), (2,), (3,)], "pair int")
    s = shots(spark, (1, "2026-10-06T12:00:00", 9), (1, "2026-10-07T02:30:00", None), (2, "2026-10-06T12:00:00", 2))
    rows = {r.pair: (r.position, r.date, r.tone) for r in ranks.latest_positions(pairs, s, ZONE, ["pair"]).withColumn("tone", ranks.position_tone(F.col("position"), F.col("date"))).collect()}
    assert rows == {1: (None, "2026-10-06", "unranked"), 2: (2, "2026-10-06", "top"), 3: (None, None, "none")}


# Follows the fixed arithmetic of the generator step by step, as a check of it has to.
def walk(key, rank_order, days):
    """The invented history, one number after another."""
    g = draws(fnv(key))
    base = min(90, 2 + rank_order * 6 + next(g) * 15)
    direction = -1 if next(g) < 0.5 else 1
    p = base + (next(g) - 0.5) * 10
    out = []
    for d in days:
        p += 0.15 * (base - p) + (next(g) + next(g) + next(g) - 1.5) * 2
        if next(draws(fnv(f"update:{d}"))) < 0.02:
            p += direction * (5 + next(g) * 10)
        p = min(100, max(1, p))
        out.append(math.floor(p + 0.5) if next(g) >= 0.05 else None)
    return out


def test_generator_and_gap_fill(spark):
    pairs = spark.createDataFrame([(1, "https://a.com/x|keyword research", 1), (2, "https://a.com/y|links", 8), (3, "z|w", 4)], "pair int, seed string, rank_order int")
    days = F.sequence(F.lit(date(2025, 9, 3)), F.lit(date(2026, 10, 7)))
    rows = ranks.generate_series(pairs, F.col("seed"), F.col("rank_order"), days).orderBy("pair", "snapshot_date").collect()
    spine = sorted({str(r.snapshot_date) for r in rows})
    assert len(spine) == 400
    for pair, key, rank in ((1, "https://a.com/x|keyword research", 1), (2, "https://a.com/y|links", 8), (3, "z|w", 4)):
        assert [r.position for r in rows if r.pair == pair] == walk(key, rank, spine)
    none = spark.createDataFrame([], "pair int, snapshot_date date")
    fill = lambda have, n: ranks.fill_snapshots(have, pairs, ["pair"], F.col("seed"), F.col("rank_order"), F.sequence(F.lit(date(2026, 9, 1)), F.lit(date(2026, 9, n))))
    first = fill(none, 20).cache()
    assert (first.count(), fill(first, 20).count(), fill(first, 21).count()) == (60, 0, 3)


@pytest.fixture(scope="module")
def tables(spark):
    ids = [f"00000000-0000-4000-8000-00000000000{i}" for i in range(6)]
    when = datetime(2026, 10, 1)
    make = lambda name, cols, rows: spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in (x.rsplit(" ", 1) for x in SCHEMAS[name].split(", ")) if c in cols))
    return ids, reads.Tables(
        make("clients", {"id", "user_id", "name", "created_at"}, [(ids[0], "u1", "Acme", when), (ids[1], "u2", "Other", when)]),
        spark.createDataFrame([(ids[2], ids[0], "https://acme.com/100%25-a", 1, "ok", "A", when), (ids[3], ids[0], "https://acme.com/b", 2, "ok", "B", when), (ids[4], ids[1], "https://other.com/x", 1, "ok", "X", when)], "id string, client_id string, url string, sitemap_position int, fetch_status string, title string, fetched_at timestamp"),
        spark.createDataFrame([(1, ids[2], 10, 9.0, 1, ["title"]), (2, ids[2], 11, 8.0, 2, ["h1"]), (3, ids[4], 12, 9.0, 1, ["title"])], "id long, page_id string, keyword_id long, score double, rank_order int, sources array<string>"),
        spark.createDataFrame([(10, "keyword research"), (11, "links"), (12, "secret term")], "id long, term string"),
        spark.createDataFrame([(ids[2], "thin_content", "warning", "m", None), (ids[2], "noindex", "error", "m", None)], "page_id string, code string, severity string, message string, details string"),
        spark.createDataFrame([(1, at("2026-10-06T12:00:00"), 7), (1, at("2026-10-07T12:00:00"), 4), (2, at("2026-10-07T12:00:00"), None)], "page_keyword_id long, captured_at timestamp, position int"),
    )


def test_list_and_detail(tables):
    ids, t = tables
    first, second = reads.list_pages(t, "u1", ZONE).collect()
    assert (first.issue_count, first.error_count, first.best_position) == (2, 1, 4)
    assert [(k.term, k.position, k.date) for k in first.keywords] == [("keyword research", 4, "2026-10-07"), ("links", None, "2026-10-07")]
    assert (second.issue_count, second.keywords, second.best_position) == (0, None, None)
    assert [r.id for r in reads.list_pages(t, "u1", ZONE, q="%").collect()] == [ids[2]]
    assert [r.id for r in reads.list_pages(t, "u1", ZONE, q="KEYWORD r").collect()] == [ids[2]]
    assert reads.count_pages(t, "u1", q="secret").first().total == 0
    assert reads.list_pages(t, "u1", ZONE, page=5, page_size=1).collect() == [] and reads.count_pages(t, "u1").first().total == 2
    [d] = reads.page_detail(t, "u1", ids[2], ZONE).collect()
    assert [i.code for i in d.issues] == ["noindex", "thin_content"] and d.fetched_at == "2026-10-01T00:00:00Z" and d.keywords[0].score == 9.0
    assert reads.page_detail(t, "u1", ids[4], ZONE).count() == 0 and reads.page_detail(t, "u1", "nonsense", ZONE).count() == 0
    for bad in ({"page": 0}, {"page_size": 101}, {"q": "x" * 201}):
        with pytest.raises(ValueError):
            reads.list_pages(t, "u1", ZONE, **bad)


def test_state(spark):
    now = F.lit(at("2026-10-07T12:00:00"))
    c = spark.createDataFrame([(1, "u", "pending", None), (2, "u", "crawling", at("2026-10-07T11:00:00")), (3, "u", "crawling", at("2026-10-07T11:59:30")), (4, "u", "done", None)], "id int, user_id string, crawl_status string, crawl_heartbeat_at timestamp").withColumn("created_at", now).withColumn("pages_total", F.lit(3)).withColumn("pages_done", F.lit(2))
    status = lambda df: {r.id: r.crawl_status for r in df.collect()}
    assert status(state.claim_crawl(c, 1, now))[1] == "discovering" and status(state.claim_crawl(c, 2, now))[2] == "crawling"
    assert status(state.requeue_stale(c, F.lit(at("2026-10-07T11:58:00")))) == {1: "pending", 2: "pending", 3: "crawling", 4: "done"}
    assert status(state.requeue_client(c, 4, "u"))[4] == "pending" and status(state.requeue_client(c, 4, "v"))[4] == "done"
    p = spark.createDataFrame([("x", s) for s in ("ok", "ok", "failed", "skipped_robots")], "client string, fetch_status string")
    assert state.crawl_outcome(p, "client").first()[3:] == ("partial", "2 of 4 pages could not be analysed")
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate([True, True, False, True, True, True, False])], "g int, i int, b boolean")
    assert [(r.run, r.stopped) for r in state.consecutive_blocks(rows, "g", ["i"], F.col("b")).orderBy("i").collect()] == [(1, False), (2, False), (0, False), (1, False), (2, False), (3, False), (0, True)]
    old = spark.createDataFrame([(1, "p", 10, 1.0), (2, "p", 11, 1.0), (3, "q", 10, 1.0)], "id int, page_id string, keyword_id int, score double")
    picks = spark.createDataFrame([("p", 11, 5.0), ("p", 12, 4.0)], "page_id string, keyword_id int, score double")
    found = {(r.page_id, r.keyword_id): (r.id, r.score) for r in state.replace_keyword_set(old, picks, spark.createDataFrame([("p",)], "page_id string")).collect()}
    assert found == {("p", 11): (2, 5.0), ("p", 12): (None, 4.0), ("q", 10): (3, 1.0)}
    token = lambda x: hashlib.sha256(x.encode()).hexdigest()
    s = spark.createDataFrame([(token("t"), "u", at("2026-10-10T00:00:00")), (token("o"), "u", at("2026-10-01T00:00:00"))], "id string, user_id string, expires_at timestamp")
    u = spark.createDataFrame([("u", "a@b.c")], "id string, email string")
    [r] = state.active_session(s, u, "t", now).collect()
    assert r.renewed and r.email == "a@b.c" and state.active_session(s, u, "o", now).count() == 0 and state.purge_sessions(s, now).count() == 1 and state.purged_count(s, now).first().deleted == 1


def site(spark, maps, hub=None, first_round=None):
    docs = spark.createDataFrame([("acme.com", u, kind, i, x) for u, (kind, locs) in maps.items() for i, x in enumerate(locs)], "site string, sitemap_url string, kind string, ord int, loc string")
    rounds = spark.createDataFrame([("acme.com", r, u, i) for r, us in enumerate(first_round, 1) for i, u in enumerate(us)], "site string, round int, sitemap_url string, ord int")
    hubs = spark.createDataFrame([("acme.com", hub)], "site string, hub_url string")
    return discovery.discover_blog(rounds, docs, hubs).orderBy("post").collect()


def test_discovery(spark):
    post = lambda i: f"https://www.acme.com/blog/how-to-post-{i}?utm_source=s"
    maps = {
        "https://acme.com/index.xml": ("index", ["https://acme.com/page-sitemap.xml", "https://acme.com/post-sitemap.xml", "https://acme.com/post-sitemap2.xml"]),
        "https://acme.com/page-sitemap.xml": ("urlset", ["https://acme.com/about", "https://acme.com/pricing"]),
        "https://acme.com/post-sitemap.xml": ("urlset", ["https://acme.com/blog", *map(post, range(10)), post(3), "https://acme.com/blog/category/x-y-z", "https://evil.com/blog/a-b-c"]),
        "https://acme.com/post-sitemap2.xml": ("urlset", list(map(post, range(10, 20)))),
    }
    rows = site(spark, maps, "https://acme.com/blog", [["https://acme.com/index.xml"]])
    assert [r.url for r in rows] == [f"https://www.acme.com/blog/how-to-post-{i}" for i in range(15)]
    assert rows[0].members == ["https://acme.com/post-sitemap.xml", "https://acme.com/post-sitemap2.xml"]
    second = site(spark, {"https://acme.com/sitemap.xml": ("urlset", [f"https://acme.com/news/a-b-{i}" for i in range(8)] + ["https://acme.com/x/y-z-w"])}, None, [["https://acme.com/gone.xml"], ["https://acme.com/sitemap.xml"]])
    assert {r.round for r in second} == {2} and len(second) == 8 and all("/news/" in r.url for r in second)
    assert site(spark, {"https://acme.com/sitemap.xml": ("urlset", ["https://acme.com/a", "https://acme.com/b"])}, None, [["https://acme.com/sitemap.xml"]]) == []


def test_hub(spark):
    links = spark.createDataFrame([(1, "https://acme.com/", 0, "/insights", "insights", True), (1, "https://acme.com/", 1, "/b", "blog", False), (1, "https://acme.com/", 2, "https://blog.acme.com/", "read", False), (1, "https://acme.com/", 3, "https://evil.com/blog", "blog", True)], "page_id long, url string, ord int, href string, text string, in_nav boolean")
    scores = {r.ord: r.score for r in discovery.hub_link_scores(links).collect()}
    assert scores == {0: 4, 1: 4, 2: 2}
    entered = spark.createDataFrame([(1, "https://acme.com")], "page_id long, entered_url string")
    assert discovery.find_hub(links, entered).first().hub_url == "https://acme.com/insights"
    assert discovery.find_hub(links, entered.withColumn("entered_url", F.lit("https://acme.com/journal?x=1#y"))).first().hub_url == "https://acme.com/journal?x=1"

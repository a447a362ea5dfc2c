"""Fetching from a local server, and a crawl's analysis."""

import contextlib
import gzip
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from siltstone.operators.crawl import analyse_crawl, is_alive, rows_from_arrays
from siltstone.sources import http

POST = "<html><head><title>{0} about tea | Acme</title></head><body><article><h1>{0}</h1><p>{0} is good. {0} is calm. {0} is warm.</p></article></body></html>"


class Site(BaseHTTPRequestHandler):
    busy = 0

    def do_GET(self):
        path = self.path
        if path == "/busy" and Site.busy < 2:
            Site.busy += 1
            self.answer(503, b"", {"Retry-After": "0"})
        elif path == "/loop":
            self.answer(302, b"", {"Location": "/loop"})
        elif path == "/moved":
            self.answer(301, b"", {"Location": "/green-tea"})
        elif path == "/gone":
            self.answer(404, b"none")
        elif path == "/file":
            self.answer(200, b"%PDF", {"Content-Type": "application/pdf"})
        elif path == "/big":
            self.answer(200, b"x" * 100_000)
        elif path in ("/map.xml", "/map.xml.gz"):
            body = b"<urlset>" + b"".join(b"<url><loc>https://a.example/%d</loc></url>" % i for i in range(2)) + b"</urlset>"
            self.answer(200, gzip.compress(body) if path.endswith("gz") else body, {"Content-Type": "application/xml"})
        elif path == "/endless.xml":
            self.answer(200, b"<urlset>" + b"<url><loc>https://a.example/x</loc></url>" * 10, {"Content-Type": "application/xml"})
            with contextlib.suppress(OSError):
                for _ in range(3000):  # far beyond the limit, if it were read
                    self.wfile.write(b"<url><loc>https://a.example/y</loc></url>" * 1000)
        elif path.startswith("/refused"):
            self.answer(403, b"no")
        else:
            self.answer(200, POST.format(path[1:].replace("-", " ").title()).encode(), {"X-Robots-Tag": "noindex"} if path == "/hidden-tea" else {})

    def answer(self, status, body, headers=None):
        self.send_response(status)
        for k, v in ({"Content-Type": "text/html; charset=utf-8"} | (headers or {})).items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(base):
    get = lambda p, **kw: http.fetch(base + p, allow_private=True, base_delay_ms=1, **kw)
    assert get("/busy")["status"] == 200 and Site.busy == 2
    assert get("/moved")["final_url"] == f"{base}/green-tea"
    assert get("/loop")["error"] == "too_many_redirects" and get("/big", limit=1000)["error"] == "too_large" and get("/gone")["status"] == 404
    assert http.fetch(base + "/x")["error"] == "blocked_host" and http.fetch("ftp://a.com/")["error"] == http.fetch("https://u:p@a.com/")["error"] == "invalid_url"
    assert http.fetch("http://127.0.0.1:1/", allow_private=True, base_delay_ms=1)["error"] == "site_unreachable"


def test_crawl(spark, base):
    paths = ["/green-tea", "/black-tea", "/gone", "/secret", "/hidden-tea", "/file"]
    entries = spark.createDataFrame([(i, "acme.com", base + p, i, p != "/secret") for i, p in enumerate(paths)] + [(10 + i, "no.com", f"{base}/refused{i}", i, True) for i in range(5)], "page_id long, site string, url string, position int, allowed boolean")
    answers = http.fetch_pages(entries.where("allowed").select("url"), delay_ms=0, allow_private=True, base_delay_ms=1).cache()
    c = analyse_crawl(entries, answers)
    assert {r.page_id: r.fetch_status for r in c.pages.collect()} == {0: "ok", 1: "ok", 2: "failed", 3: "skipped_robots", 4: "ok", 5: "failed", **dict.fromkeys(range(10, 15), "blocked")}
    out = {r.site: (r.status, r.message, r.error_code) for r in c.outcomes.collect()}
    assert out == {"acme.com": ("partial", "3 of 6 pages could not be analysed", None), "no.com": ("partial", "5 of 5 pages could not be analysed", "blocked_by_site")}
    issues = {}
    for r in c.issues.collect():
        issues.setdefault(r.page_id, {})[r.code] = r.message
    assert issues[2] == {"http_error": "URL listed in the sitemap returns HTTP 404"} and 3 not in issues and "noindex" in issues[4]
    assert issues[5] == {"http_error": "URL listed in the sitemap could not be fetched: Not an HTML page (application/pdf)"}
    assert issues[14] == {"http_error": "URL listed in the sitemap could not be fetched: blocked by the site"} and issues[10] == {"http_error": "URL listed in the sitemap returns HTTP 403"}
    picks = {r.page_id: r.term for r in c.picks.where("rank_order = 1").collect()}
    assert picks[0] == "green tea" and picks[1] == "black tea" and set(picks) == {0, 1, 4}


def test_small_things(spark):
    assert is_alive(spark)
    arrays = spark.createDataFrame([(7, [1, 2], ["x", None])], "k int, a array<int>, b array<string>")
    assert sorted(map(tuple, rows_from_arrays(arrays, "a", "b").collect())) == [(7, 1, "x"), (7, 2, None)]


def test_settings():
    from siltstone import config

    assert config.load({}) == config.Settings()
    found = config.load({"SILTSTONE_DELAY_MS": "250", "SILTSTONE_LOG_LEVEL": "INFO", "SILTSTONE_ROBOTS_AGENT": " bot "})
    assert (found.delay_ms, found.log_level, found.robots_agent, found.post_limit) == (250, "INFO", "bot", 15)
    with pytest.raises(ValueError, match="delay_ms, log_level"):
        config.load({"SILTSTONE_DELAY_MS": "-1", "SILTSTONE_LOG_LEVEL": "loud"})


def test_report(spark, capsys):
    from siltstone import report

    assert report.main([]) == 2 and "discovery finds" in capsys.readouterr().out
    kind = "page_id long, entered_url string, origin string, hub_url string, round int, members array<string>, post int, url string, allowed boolean, crawl_delay double, error_code string"
    maps = [f"https://a.example/{i}.xml" for i in range(5)]
    rows = [(1, "https://www.a.example/", "https://a.example", None, 1, maps, 2, "https://a.example/y", False, 2.5, None), (1, "https://www.a.example/", "https://a.example", None, 1, maps, 1, "https://a.example/x", True, 2.5, None), (2, "https://b.example/", None, None, None, None, None, None, None, None, "timeout")]
    said = {}
    for r in report.lines(spark.createDataFrame(rows, kind)).orderBy("page_id", "line").collect():
        said.setdefault(r.page_id, []).append(r.text)
    assert said[1] == ["site: https://a.example", "hub: none linked", f"sitemaps: {', '.join(maps[:3])} and 2 more", "pause: 2.5 s", "posts: 2", "  1  https://a.example/x", "  2  https://a.example/y  (forbidden by robots.txt)"]
    assert said[2] == ["site: https://b.example/", "nothing found (timeout): The website took too long to respond."]


def test_seed_conditions(spark):
    """What has to hold before and after a seed: pairs, keywords of every client, rows enough."""
    from datetime import date

    from siltstone.operators import reads, seed

    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    clients = table([("c", "u", "Shop")], "id string, user_id string, name string")
    pages = table([("p", "c", "https://a.example/")], "id string, client_id string, url string")
    terms, shots = table([(1, "tea")], "id long, term string"), table([(9, date(2026, 10, 6), 3)], "page_keyword_id long, snapshot_date date, position int")
    pairs = table([(9, "p", 1, 1)], "id long, page_id string, keyword_id long, rank_order int")
    of = lambda c, k: reads.Tables(c, pages, k, terms, None, shots)
    made = seed.seed_ranks(of(clients, pairs), date(2026, 10, 7), 400).collect()
    assert len(made) == 399 and min(r.snapshot_date for r in made) == date(2025, 9, 3)
    with pytest.raises(LookupError, match="nothing to track"):
        seed.seed_ranks(of(clients, pairs.limit(0)), date(2026, 10, 7))
    with pytest.raises(LookupError, match="no keywords of Other"):
        seed.seed_ranks(of(clients.unionByName(table([("d", "u", "Other")], "id string, user_id string, name string")), pairs), date(2026, 10, 7))


def test_sitemaps_over_http(spark, base):
    """Sitemaps are left as soon as there are locations enough; packed, missing and foreign ones."""
    urls = spark.createDataFrame([("a", f"{base}/{p}") for p in ("map.xml", "map.xml.gz", "endless.xml", "gone", "green-tea")], "site string, sitemap_url string")
    rows = http.fetch_sitemaps(urls, most=5, allow_private=True, base_delay_ms=1).collect()
    found = {}
    for r in rows:
        found.setdefault(r.sitemap_url.rsplit("/", 1)[1], []).append((r.ord, r.loc))
    assert set(found) == {"map.xml", "map.xml.gz", "endless.xml"} and sorted(found["map.xml"]) == [(0, "https://a.example/0"), (1, "https://a.example/1")] == sorted(found["map.xml.gz"])
    assert len(found["endless.xml"]) == 5

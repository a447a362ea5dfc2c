"""Scalar functions: text, URLs, addresses, encodings, robots and sitemaps."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import dates, net, text, urls
from siltstone.functions.constants import STOPWORDS
from siltstone.functions.phrases import phrase_array, phrase_lists
from siltstone.sources.sitemap import SitemapReader, parse_robots, read_sitemap, robots_check, robots_verdict, sitemap_urls


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_phrases(spark):
    [found] = column(spark, ["How to rank: the keyword research guide."], phrase_array)
    assert {"keyword research", "rank", "keyword research guide"} <= set(found)
    assert not {"how to rank", "rank the keyword", "the keyword"} & set(found)
    [found] = column(spark, ["data science for seo 2024 teashop's ab"], lambda c: phrase_array(c, False))
    assert "data science" in found and "data science for seo" not in found and "2024" not in found and "teashop's" not in found and "ab" not in found
    assert column(spark, [None, "", "... - !"], phrase_array) == [[], [], []]
    assert column(spark, ["ﬁne Ⅷ Ｔｅａ", "cafe\u0301 - x‘s\0end"], phrase_array) == [["fine", "fine viii", "fine viii tea", "viii", "viii tea", "tea"], ["café", "x's end", "end"]]


def plain_phrases(value, inner):
    """Phrases of a text, segment by segment and word by word."""
    import regex

    found = []
    for segment in regex.split(r"[.,;:!?()\[\]{}\x22“”|/\\–—]+|\s-\s", value.lower()):
        w = regex.findall(r"[\p{L}\p{N}]+(?:'[\p{L}]+)?", segment)
        edge = [x not in STOPWORDS and not x.isdigit() for x in w]
        for i in range(len(w)):
            for n in range(1, min(4, len(w) - i) + 1):
                run = w[i : i + n]
                if edge[i] and edge[i + n - 1] and not run[-1].endswith("'s") and (n > 1 or len(w[i]) > 2) and (inner or not any(x in STOPWORDS for x in run)):
                    found.append(" ".join(run))
    return found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abc  the's é1-.,|\t")), max_size=60), max_size=5), st.booleans())
def test_phrases_are_those_of_a_plain_reading(texts, inner):
    found, sizes = phrase_lists(texts, inner)
    assert found.to_pylist() == [p for t in texts for p in plain_phrases(t, inner)]
    assert sizes.tolist() == [len(plain_phrases(t, inner)) for t in texts]


def test_text_basics(spark):
    assert column(spark, [" a \n b ", None], text.collapse) == ["a b", None]
    assert column(spark, ["don’t well-known x2 — ok", ""], text.word_count) == [4, 0]
    assert column(spark, ["a😀b", None], text.utf16_length) == [4, None]
    assert column(spark, ["What is SEO? • Teashop", "plain", "a - b | c"], text.strip_site_name) == ["What is SEO?", "plain", "a b"]
    assert column(spark, ["x | Acme Inc ", "x", None], text.site_name) == ["acme inc", None, None]
    assert column(spark, [" Me@X.Com "], text.normalize_email) == ["me@x.com"]


def fnv(value):
    h = 0x811C9DC5
    for c in value:
        h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
    return h


# Follows the fixed arithmetic of the generator step by step, as a check of it has to.
def draws(seed):
    state = seed
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (1 | state)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (61 | t))) & 0xFFFFFFFF
        yield ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296


def test_hash_and_draws(spark):
    keys = ["", "a", "https://a.com/x|keyword research", "update:2026-10-07", "é"]
    assert column(spark, keys, text.fnv1a) == [fnv(k) for k in keys]
    for k in (1, 2, 7, 500):
        found = column(spark, keys, lambda c: text.draw(text.fnv1a(c), F.lit(k)))  # noqa: B023
        expected = []
        for key in keys:
            g = draws(fnv(key))
            expected.append([next(g) for _ in range(k)][-1])
        assert found == expected


def test_urls(spark):
    assert column(spark, ["https://a.com/post/?utm_source=x&page=2#comments", "HTTP://A.com", "ftp://a.com/", "https://a.com/?ref=1", "https://a.com/x?b=1&gclid=2&c"], urls.normalize_page_url) == ["https://a.com/post/?page=2", "http://a.com/", None, "https://a.com/", "https://a.com/x?b=1&c"]
    assert column(spark, ["teashop.com", "www.teashop.com", "WWW.Teashop.com."], urls.site_key) == ["teashop.com"] * 3
    assert column(spark, ["https://x.com/a/b-c_d.html?q=1", "https://x.com/", "https://x.com/caf%C3%A9+bar", "https://x.com/%zz"], urls.slug_text) == ["b c d", "", "café+bar", ""]
    assert column(spark, ["/blog/how-to-rank", "/a/b/c/d/e-f-g", "/2024/05/x", "/about", "/"], urls.is_article_shaped) == [True, False, True, False, False]
    assert column(spark, ["https://a.com/post-sitemap2.xml", "https://a.com/sitemap12.xml.gz", "https://a.com/v2/map.xml"], urls.family_key) == ["https://a.com/post-sitemap.xml", "https://a.com/sitemap.xml.gz", "https://a.com/v2/map.xml"]
    assert column(spark, ["https://a.com/post-sitemap.xml", "https://a.com/blog/sitemap/", "https://a.com/sitemap_articles_1.xml"], urls.name_tokens) == [["post"], ["blog"], ["articles"]]
    assert column(spark, ["/blog/x", "/blog", "/blogging-tools/"], lambda c: urls.is_under(c, F.lit("/blog"))) == [True, True, False]
    assert column(spark, ["blog.example.com", "example.com", "www.example.com", "x.example.org"], lambda c: urls.is_subdomain(c, F.lit("www.example.com"))) == [True, False, False, False]
    assert column(spark, ["/a", "../x?y#z", "mailto:a@b", "//c.org", "https://b.com:99999/"], lambda c: urls.resolve(c, F.lit("https://a.com/p/q"))) == ["https://a.com/a", "https://a.com/x?y#z", None, "https://c.org/", None]
    assert column(spark, ["/tag/x", "/blog/page/2/", "/x.pdf", "/blog/x"], urls.is_archive_or_file) == [True, True, True, False]


def test_public_addresses(spark):
    rows = {"8.8.8.8": True, "10.1.2.3": False, "100.64.0.1": False, "172.32.0.1": True, "192.0.2.9": False, "255.255.255.255": False, "2606:4700::1": True, "::1": False, "::ffff:10.0.0.1": False, "::ffff:8.8.8.8": True, "fe80::1": False, "example.com": False, "1.2.3": False, "256.1.1.1": False}
    assert column(spark, list(rows), net.is_public_address) == list(rows.values())
    targets = {"https://a.com/": None, "ftp://a.com/": "invalid_url", "https://u:p@a.com/": "invalid_url", "http://a.com:8080/": "blocked_host", "http://127.0.0.1/": "blocked_host", "http://[::1]/": "blocked_host", "nonsense": "invalid_url", "https://a.com:443/x": None}
    assert column(spark, list(targets), net.target_error) == list(targets.values())


def test_retries(spark):
    df = spark.createDataFrame([(1, None, 0.5), (3, None, 0.0), (1, "7", 0.9), (1, "100", 0.0), (1, "soon", 0.0)], "a int, r string, x double")
    assert [r[0] for r in df.select(net.retry_delay_ms(F.col("a"), F.col("r"), F.col("x"))).collect()] == [500.0, 1000.0, 7000.0, 30000.0, 250.0]
    df = spark.createDataFrame([(503, None, 1), (503, None, 3), (404, None, 1), (None, "timeout", 2)], "s int, e string, a int")
    assert [bool(r[0]) for r in df.select(net.should_retry(F.col("s"), F.col("e"), F.col("a"))).collect()] == [True, False, False, True]


def test_redirects(spark):
    hops = [(f"https://a.com/{i}", f"https://a.com/{i + 1}") for i in range(9)] + [("https://b.com/", "http://10.0.0.1/")]
    got = net.follow_redirects(spark.createDataFrame([("https://a.com/0",), ("https://a.com/6",), ("https://b.com/",)], "url string"), spark.createDataFrame(hops, "src string, dst string"))
    found = {r.url: (r.final_url, r.hops, r.error) for r in got.collect()}
    assert found["https://a.com/6"] == ("https://a.com/9", 3, None)
    assert found["https://a.com/0"] == ("https://a.com/5", 5, "too_many_redirects")
    assert found["https://b.com/"] == ("http://10.0.0.1/", 1, "blocked_host")


def test_decode_body(spark):
    rows = [("é".encode("latin-1"), "text/html; charset=ISO-8859-1"), ('<meta charset="windows-1251">Ж'.encode("cp1251"), "text/html"), ("é".encode(), "text/html; charset=nope"), ("é".encode(), None), (None, None)]
    df = spark.createDataFrame([(bytearray(a) if a is not None else None, b) for a, b in rows], "b binary, k string")
    found = [r[0] for r in df.select(net.decode_body(F.col("b"), F.col("k"))).collect()]
    assert found[0] == "é" and found[1].endswith("Ж") and found[2:] == ["é", "é", None]


SITEMAP = b"""<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://x/">
<url><loc> https://a.com/1?x=1&amp;y=2 </loc><image:image><image:loc>https://a.com/i.png</image:loc></image:image></url><url><loc><![CDATA[https://a.com/2]]></loc></url>"""


def test_sitemaps(spark):
    assert read_sitemap(SITEMAP + b"</urlset>") == ("urlset", ["https://a.com/1?x=1&y=2", "https://a.com/2"], True)
    assert read_sitemap(SITEMAP) == ("urlset", ["https://a.com/1?x=1&y=2", "https://a.com/2"], False)
    assert read_sitemap(SITEMAP + b"</urlset>", 1)[1] == ["https://a.com/1?x=1&y=2"]
    assert read_sitemap(b"\xef\xbb\xbf<sitemapindex><sitemap><loc>https://a.com/s.xml</loc></sitemap></sitemapindex>")[:2] == ("index", ["https://a.com/s.xml"])
    assert read_sitemap(b"https://a.com/1\r\nnot a url\n https://a.com/2 ") == ("text", ["https://a.com/1", "https://a.com/2"], True)
    assert read_sitemap("<html><body>x</body></html>")[0] == "unknown"
    assert read_sitemap(None) == ("unknown", [], True)
    df = spark.createDataFrame([("a.com", "https://a.com/s.xml", bytearray(SITEMAP)), ("a.com", "x", None)], "site string, sitemap_url string, body binary")
    assert [r.loc for r in sitemap_urls(df).orderBy("ord").collect()] == [None, "https://a.com/1?x=1&y=2", "https://a.com/2"]


def test_robots(spark):
    groups, maps = parse_robots("Sitemap: https://a.com/s.xml\nUser-agent: *\nDisallow: /private\nAllow: /private/open$\nCrawl-delay: 3\n\nUser-agent: bad\nUser-agent: worse\nDisallow: /")
    assert maps == ["https://a.com/s.xml"]
    assert robots_verdict(groups, "Good", "https://a.com/private/x") == (False, 3.0)
    assert robots_verdict(groups, "Good", "https://a.com/private/open") == (True, 3.0)
    assert robots_verdict(groups, "worse", "https://a.com/x")[0] is False
    df = spark.createDataFrame([("https://a.com/p", 200, "text/html", "User-agent: *\nDisallow: /"), ("https://a.com/p", 200, "text/plain", "User-agent: *\nDisallow: /"), ("https://a.com/p", 404, None, None)], "url string, status int, content_type string, robots string")
    assert sorted(r.allowed for r in robots_check(df, "x").collect()) == [False, True, True]


def test_sitemaps_in_parts():
    """Whatever the parts in which the bytes come, the same is read; no more is asked for than is wanted."""
    whole = SITEMAP.replace(b"/2", "/é😀".encode()) + b"</urlset>"
    for size in (1, 2, 3, 7):
        reader = SitemapReader()
        assert all(reader.feed(whole[i : i + size]) for i in range(0, len(whole), size))
        reader.feed(b"", True)
        assert reader.result() == read_sitemap(whole)
    reader, taken = SitemapReader(1), 0
    while reader.feed(whole[taken : taken + 10]):
        taken += 10
    assert taken < len(whole) - 20 and reader.result() == ("urlset", ["https://a.com/1?x=1&y=2"], False)
    lines = SitemapReader(2)
    assert lines.feed(b" \n https://a.com/1\r\nhttps://a.c") and lines.feed(b"om/2\nx\n") and not lines.feed(b"https://a.com/3\n")
    assert lines.result() == ("text", ["https://a.com/1", "https://a.com/2"], False)


def test_ranges(spark):
    from datetime import date

    assert dates.checked_range(None, "2026-10-07", date(2026, 1, 1)) == (date(2026, 7, 10), date(2026, 10, 7))
    for bad in (("2026-10-08", "2026-10-07"), ("2024-10-07", "2026-10-07"), ("x", None)):
        with pytest.raises(ValueError):
            dates.checked_range(*bad, date(2026, 10, 7))
    assert column(spark, [240, 100, 0, None], lambda c: dates.history_days(c, 50_000), "int") == [365, 500, 365, 365]

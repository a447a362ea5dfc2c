"""Queries over rows made from the benchmark tables: pages with all features, whole sites, answers, sessions, states.

What the tables don't hold (metadata, media, robots, hubs, sitemap indexes, redirects, composed letters) is made here from
their keys, so that each operator runs on it. The SQL twins state what has to come out of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import report
from siltstone.errors import InvalidRequest
from siltstone.functions import dates, net, text, urls
from siltstone.functions.lineage import cut, remove, shared_dir
from siltstone.operators import crawl, discovery, issues, keywords, ranks, reads, seed, state
from siltstone.plans import analogues as A
from siltstone.sources import html, http, schema
from siltstone.sources.sitemap import sitemap_urls
from siltstone.streaming.snapshots import update_counts

ZONE, OWNER = "America/Toronto", 3
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def _pick(key: str, values: list[str]) -> str:
    """SQL: one of the expressions, by key modulo their number."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


# --- pages with all features


_HEAD = {
    "title": _pick("k", ["''", "'<title>T' || k || '</title>'", "'<title>The complete guide to every ' || name || ' and how to pick the right one</title>'", "'<title>Shared title of many pages in a shop</title>'", "'<title>' || repeat('😀', 16) || ' ' || name || '</title>'", "'<title>' || name || ' for every home &amp; garden | Shop</title>'", "'<title> Buy\\n the ' || name || ' &mdash; best &#8364; prices today </title>'"]),
    "meta": _pick("k", ["''", "'<META NAME=\"Description\" CONTENT=\" A  ' || kind || ' ' || name || ' \">'", "'<meta name=description content=\"\">'"]),
    "canonical": _pick("k", ["''", "'<link rel=canonical href=\"' || url || '#top\">'", "'<link href=\"/p/' || slug || '-' || k || '\" rel=\"canonical\">'", "'<link rel=\"canonical\" href=\"/p/other\">'", "'<link rel=\"canonical\" href=\"mailto:shop@example.com\">'"]),
    "robots": _pick("k", ["'<meta name=\"ROBOTS\" content=\"NOINDEX, follow\">'", "'<meta name=\"robots\" content=\"googlebot: noindex\">'", "''", "''", "''", "''"]),
    "linked": _pick("k", ["''", "'<script type=\"application/ld+json\">{\"@type\":\"Product\",\"keywords\":\"' || name || ', tea pots\"}</script>'", "'<script type=\"application/ld+json\">{\"@graph\":[{\"@type\":[\"Article\",\"Thing\"],\"keywords\":[\"garden tools\",\"x\"]}, 5]}</script>'", "'<script type=\"application/ld+json\">{broken</script>'"]),
    "insecure": _pick("k", ["'<script src=\"http://cdn.example/a.js\"></script><link rel=\"stylesheet\" href=\"http://cdn.example/a.css\">'", "''", "''"]),
    "scripts": _pick("k", ["'<script>x()</script>'", "'<script src=\"/app.js\"></script>'", "''", "''"]),
}
_BODY = {
    "h1": _pick("k", ["''", "'<h1>All about <b>' || name || '</b></h1>'", "'<h1>' || name || '</h1><h1>Second &lt;one&gt;</h1>'", "'<h1> </h1><h1>Ｔｅａ ' || name || '</h1>'"]),
    "headings": _pick("k", ["'<h2>Care of ' || name || '</h2><h3>Sizes</h3>'", "''"]),
    "images": _pick("k", ["''", "'<img src=\"/a.png\" alt=\"\">'", "'<img src=\"/a.png\" alt><img src=\"/b.png\">'", "'<img src=\"/a.png\" alt=\"a\"><img src=\"/b.png\"><img>'"]),
}
_WORDS = "'<p>' || rtrim(repeat(name || ' ', " + _pick("CAST(floor(k / 3) AS BIGINT)", ["3", "60", "200"]) + ")) || '</p><div>tail&nbsp;end</div><aside>not this</aside>'"
_CONTENT = _pick("k", [f"'<article>' || {_WORDS} || '</article><iframe src=\"http://cdn.example/f\"></iframe>'", f"'<main>' || {_WORDS} || '</main><div>nor this</div>'", _WORDS])
_HTML = f"'<!doctype html><html' || {_pick('k', [chr(39) * 2] + [chr(39) + ' lang=' + chr(34) + ' en-GB ' + chr(34) + chr(39)] * 3)} || '><head>' || {' || '.join(_HEAD.values())} || '</head><body><header><nav><a href=\"/blog\">Blog</a></nav>' || {' || '.join(_BODY.values())} || '</header>' || {_CONTENT} || '<footer>end</footer></body></html>'"


def made_pages(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, site, url, html, x_robots): a web page for every part, its features by the key's remainders."""
    p = A.table(spark, d, "part").selectExpr("p_partkey AS k", "p_name AS name", "p_type AS kind", "replace(p_name, ' ', '-') AS slug")
    p = p.selectExpr("*", "CASE WHEN k % 2 = 0 THEN 'https' ELSE 'http' END || '://www.shop' || k % 5 || '.example/p/' || slug || '-' || k AS url")
    x_robots = _pick("k", ["NULL", "NULL", "NULL", "'otherbot: noindex'", "'unavailable_after: 25 Jun 2030'", "'none'"])
    return p.selectExpr("k AS page_id", "'shop' || k % 5 || '.example' AS site", "url", f"{_HTML} AS html", f"{x_robots} AS x_robots")


def _made_facts(spark: SparkSession, d: str) -> DataFrame:
    p = made_pages(spark, d)
    return html.page_facts(p).withColumn("site", urls.site_key(urls.host(F.col("url"))))


@query
def made_page_facts(spark, d):
    """All facts of pages with metadata, JSON-LD, media, scripts and main text in each kind of container."""
    join = lambda c: F.array_join(c, "|").alias(c)
    return _made_facts(spark, d).select("page_id", "site", "title", "meta_description", join("h1s"), join("headings"), "canonical", "robots", "lang", join("jsonld_types"), join("jsonld_keywords"), "images_total", join("images_missing_alt"), "insecure_resources", "main_text", "script_count", "word_count")


@query
def made_page_issues(spark, d):
    """All 13 rules, with their details, canonical URLs resolved."""
    return issues.find_issues(_made_facts(spark, d)).select("page_id", "code", "severity", "message", "details")


@query
def made_candidates(spark, d):
    """Phrase candidates of all eight places; full-width letters are composed."""
    c = keywords.candidates(_made_facts(spark, d))
    return c.select("site", "page_id", "term", F.array_join("sources", ",").alias("sources"), "body_count")


# --- URLs, addresses, answers


@query
def url_forms(spark, d):
    """Normal forms of absolute, relative, international and odd references."""
    href = _pick("k", ["'../x/' || slug || '?utm_source=a&b=1#c'", "'//www.Shop.example:443/A%20b?ref=1'", "'HTTP://bücher.example:80/é ' || slug", "'mailto:a@b.example'", "'?page=' || k", "' https://a.example/x?gclid=1&fbclid=2 '", "'https://a.example:99999/'", "'https://a.example:8443/?reference=1'"])
    p = A.table(spark, d, "part").selectExpr("p_partkey AS k", "replace(p_name, ' ', '-') AS slug").selectExpr("k AS p_partkey", f"{href} AS href", "'https://base.example/a/b?q=1' AS base")
    return p.select("p_partkey", urls.normalize_page_url(F.col("href"), F.col("base")).alias("url"), urls.normalize_page_url(F.col("href")).alias("absolute"))


@query
def website_forms(spark, d):
    """Websites as customers enter them, one valid form and several others."""
    entered = _pick("k", ["' https://WWW.Shop' || k || '.example/blog?x=1#y '", "'shop' || k || '.example'", "'http://bücher.example/' || k", "'http://localhost:' || k", "'https://shop' || k || '.example.:443'", "'https://u@shop.example/'", "'http://[2606:4700::' || (k + 1) || ']/x'"])
    c = A.table(spark, d, "customer").selectExpr("c_custkey AS k").selectExpr("k AS c_custkey", f"{entered} AS entered")
    return c.select("c_custkey", urls.parse_website(F.col("entered")).alias("w")).select("c_custkey", "w.url", "w.origin", "w.site_key")


@query
def url_containment(spark, d):
    """Hosts below a site, and paths below a hub."""
    h = _pick("k", ["'shop.example'", "'www.shop.example'", "'blog.shop.example'", "'notshop.example'", "'a.b.Shop.example'"])
    p = _pick("k", ["'/blog'", "'/blog/'", "'/blog/' || slug", "'/blogging/' || slug", "'/fr/blog'", "'/de-at/' || slug", "'/english/x'"])
    x = A.table(spark, d, "part").selectExpr("p_partkey AS k", "replace(p_name, ' ', '-') AS slug").selectExpr("k AS p_partkey", f"{h} AS h", f"{p} AS p")
    return x.select("p_partkey", urls.is_subdomain(F.col("h"), F.lit("www.shop.example")).alias("below"), urls.is_under(F.col("p"), F.lit("/blog")).alias("inside"), urls.has_locale(F.col("p")).alias("locale"))


@query
def ip_addresses(spark, d):
    """IPv6 addresses, IPv4 ones within them, and texts that are none."""
    low = "concat_ws(':', transform(sequence(48, 0, -16), i -> lower(hex(shiftrightunsigned(k, i) & 65535))))"  # a group has 16 bits
    ip = _pick("k", ["'::1'", f"'fe80::' || {low}", f"'2001:db8::' || {low}", f"'2606:4700::' || {low}", "'::ffff:10.0.0.' || k % 250", "'::FFFF:8.8.8.' || k % 250", "'fc00::1'", "'not:an:address'", "'1.2.3'", "'172.' || (16 + k % 20) || '.0.1'"])
    o = A.table(spark, d, "orders").selectExpr("CAST(o_orderkey AS BIGINT) AS k").selectExpr("k AS o_orderkey", f"{ip} AS ip")
    return o.select("o_orderkey", net.is_public_address(F.col("ip")).alias("public"))


_TARGETS = _pick("k", ["'https://a.example/' || k", "'ftp://a.example/' || k", "'http://u:p@a.example/' || k", "'http://10.0.0.' || k % 250 || '/' || k", "'https://[::1]/' || k", "'http://a.example:8080/' || k", "'https://8.8.8.8:443/' || k", "'https:///' || k"])


@query
def url_targets(spark, d):
    """Why a URL may not be fetched, where private addresses are allowed and where not."""
    c = A.table(spark, d, "customer").selectExpr("c_custkey AS k").selectExpr("k AS c_custkey", f"{_TARGETS} AS url")
    return c.select("c_custkey", net.target_error(F.col("url")).alias("error"), net.target_error(F.col("url"), True).alias("error_inside"))


@query
def fetch_refusals(spark, d):
    """The fetcher's answers to targets that it never asks."""
    s = A.table(spark, d, "supplier").selectExpr("s_suppkey AS k").where("k % 8 IN (1, 2, 3, 4, 5)").selectExpr(f"{_TARGETS} AS url")
    return http.fetch_pages(s, partitions=4, delay_ms=0).select("url", "status", "error")


@query
def redirect_chains(spark, d):
    """Chains of up to seven hops, some of which end at a private address or another scheme."""
    o = A.table(spark, d, "orders").selectExpr("o_orderkey AS k")
    links = o.selectExpr("k", "inline(transform(sequence(0, 7), i -> struct(i AS i)))").where("i < k % 8")
    end = "CASE WHEN i = k % 8 - 1 AND k % 11 = 0 THEN 'https://192.168.0.' || k % 250 || '/' WHEN i = k % 8 - 1 AND k % 13 = 0 THEN 'ftp://a.example/' ELSE 'https://a.example/' || k || '/' || (i + 1) END"
    return net.follow_redirects(o.selectExpr("'https://a.example/' || k || '/0' AS url"), links.selectExpr("'https://a.example/' || k || '/' || i AS src", f"{end} AS dst")).select("url", "final_url", F.col("hops").cast("long").alias("hops"), "error")


@query
def retry_policy(spark, d):
    """Whether an attempt is followed by another, and after what pause."""
    o = A.table(spark, d, "orders").selectExpr("o_orderkey AS k").selectExpr("k AS o_orderkey", f"{_pick('k', ['200', '429', '500', '503', '404'])} AS status", f"{_pick('k', ['NULL', 'NULL', chr(39) + 'timeout' + chr(39), chr(39) + 'site_unreachable' + chr(39), chr(39) + 'too_large' + chr(39), 'NULL', 'NULL'])} AS error", "CAST(k % 4 + 1 AS INT) AS attempt", f"{_pick('k', [chr(39) + x + chr(39) for x in ('2', ' 120 ', '1.5', 'soon')] + ['NULL', 'NULL'])} AS retry_after", "CAST(k % 100 AS DOUBLE) / 100 AS random")
    return o.select("o_orderkey", F.coalesce(net.should_retry(F.col("status"), F.col("error"), F.col("attempt")), F.lit(False)).alias("again"), F.round(net.retry_delay_ms(F.col("attempt"), F.col("retry_after"), F.col("random")), 6).alias("pause_ms"))


@query
def decoded_bodies(spark, d):
    """Bodies in several encodings, named by the header, by a meta tag, by nobody, or wrongly."""
    body = {0: ("name || ' é€'", "UTF-8", "text/html; charset=utf-8"), 1: ("name || ' é'", "ISO-8859-1", "text/html; charset=ISO-8859-1"), 2: ("'<meta charset=latin1>' || name || ' é'", "ISO-8859-1", "text/html"), 3: ("name || ' é€'", "UTF-8", "text/html; charset=x-nope"), 4: ("'\\uFEFF' || name", "UTF-8", None), 5: ("name || ' é'", "UTF-16", "text/html; charset=UTF-16")}
    p = A.table(spark, d, "part").selectExpr("p_partkey AS k", "p_name AS name")
    data = F.coalesce(*[F.when(F.col("k") % 6 == i, F.encode(F.expr(x), kind)) for i, (x, kind, _) in body.items()])
    header = F.coalesce(*[F.when(F.col("k") % 6 == i, F.lit(h)) for i, (_, _, h) in body.items()])
    return p.select(F.col("k").alias("p_partkey"), net.decode_body(data, header).alias("body"))


@query
def text_hashes(spark, d):
    """FNV-1a beyond the basic plane too, and the stored ids of tokens."""
    p = A.table(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit("|é😀"), F.col("p_partkey").cast("string")).alias("x"))
    return p.select("p_partkey", text.fnv1a(F.col("x")).alias("fnv"), text.token_id(F.col("x")).alias("token_id"), text.utf16_length(F.col("x")).cast("long").alias("units"))


# --- whole sites


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "supplier").selectExpr("s_suppkey AS k", "'s' || s_suppkey || '.example' AS h")


def made_sites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(homepages, robots, documents) of a site for every supplier, each of ten kinds.

    0 refuses; 1 times out; 2 answers 500; 3 has no sitemap; 4 lists no posts; 5 lists posts in robots.txt, of which it
    forbids some; 6 has its blog on a subdomain; 7 has an index below its blog; 8 redirects in a loop; 9 was entered by its
    hub, and mixes all pages in the usual place.
    """
    s = _sites(spark, d)
    nav = "'<html><body><nav><a href=\"/about\">About</a>' || CASE k % 10 WHEN 6 THEN '<a href=\"https://news.' || h || '/\">Read</a>' WHEN 7 THEN '<a href=\"/journal/\">Blog</a>' WHEN 5 THEN '<a href=\"/insights\">Insights</a><a href=\"https://other.example/blog\">Blog</a>' ELSE '' END || '</nav></body></html>'"
    home = s.selectExpr("k AS page_id", "'https://www.' || h || CASE WHEN k % 10 = 9 THEN '/stories/' ELSE '' END AS entered_url", "'https://' || h || CASE WHEN k % 10 = 9 THEN '/stories/' ELSE '/' END AS url", "CASE k % 10 WHEN 0 THEN 403 WHEN 1 THEN NULL WHEN 2 THEN 500 WHEN 8 THEN NULL ELSE 200 END AS status", "CASE k % 10 WHEN 1 THEN 'timeout' WHEN 8 THEN 'too_many_redirects' END AS error", f"{nav} AS html")
    rules = "'User-agent: *\\nCrawl-delay: 3\\nDisallow: /insights/a-long-post-1*\\nSitemap: https://other.example/sitemap.xml\\nSitemap: https://' || h || '/page-sitemap.xml\\nSitemap: https://' || h || '/post-sitemap.xml\\nSitemap: https://' || h || '/fr/post-sitemap.xml'"
    robots = s.where("k % 10 IN (5, 9)").selectExpr("'https://' || h AS origin", "200 AS status", "CASE WHEN k % 10 = 5 THEN 'text/plain' ELSE 'text/html' END AS content_type", f"{rules} AS robots")
    page = lambda where, url, locs, form="urlset", tag="url": s.where(where).selectExpr("h AS site", f"{url} AS sitemap_url", f"'<?xml version=\"1.0\"?><{form} xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">' || array_join(transform({locs}, x -> '<{tag}><loc>' || x || '</loc></{tag}>'), '') || '</{form}>' AS body")
    posts = lambda base, n: f"transform(sequence(0, {n - 1}), i -> {base} || 'a-long-post-' || i || '?utm_source=map')"
    maps = [
        page("k % 10 = 4", "'https://' || h || '/sitemap.xml'", "array('https://' || h || '/about', 'https://' || h || '/pricing')"),
        page("k % 10 = 5", "'https://' || h || '/page-sitemap.xml'", "array('https://' || h || '/insights', 'https://' || h || '/contact')"),
        page("k % 10 = 5", "'https://' || h || '/post-sitemap.xml'", f"concat(array('https://' || h || '/insights', 'https://' || h || '/insights/tag/a-b-c'), {posts(chr(39) + 'https://' + chr(39) + ' || h || ' + chr(39) + '/insights/' + chr(39), 20)})"),
        page("k % 10 = 5", "'https://' || h || '/fr/post-sitemap.xml'", posts("'https://' || h || '/fr/insights/'", 20)),
        page("k % 10 = 6", "'https://news.' || h || '/sitemap_index.xml'", "array('https://cdn.example/' || k || '/sitemap-1.xml', 'https://cdn.example/' || k || '/gone.xml')", "sitemapindex", "sitemap"),
        page("k % 10 = 6", "'https://cdn.example/' || k || '/sitemap-1.xml'", posts("'https://news.' || h || '/2024/05/'", 6)),
        page("k % 10 = 6", "'https://' || h || '/sitemap.xml'", posts("'https://' || h || '/wrong/'", 20)),
        page("k % 10 = 7", "'https://' || h || '/journal/sitemap_index.xml'", "array('https://' || h || '/journal/post-sitemap.xml', 'https://' || h || '/journal/post-sitemap2.xml', 'https://' || h || '/journal/category-sitemap.xml')", "sitemapindex", "sitemap"),
        page("k % 10 = 7", "'https://' || h || '/journal/post-sitemap.xml'", posts("'https://' || h || '/journal/'", 9)),
        page("k % 10 = 7", "'https://' || h || '/journal/post-sitemap2.xml'", posts("'https://' || h || '/journal/more/'", 9)),
        page("k % 10 = 7", "'https://' || h || '/journal/category-sitemap.xml'", posts("'https://' || h || '/journal/category/'", 20)),
        page("k % 10 = 9", "'https://' || h || '/sitemap-index.xml'", f"concat(array('https://' || h || '/stories/', 'https://' || h || '/help/a-b-c'), {posts(chr(39) + 'https://' + chr(39) + ' || h || ' + chr(39) + '/stories/' + chr(39), 5)})"),
    ]
    documents = maps[0]
    for m in maps[1:]:
        documents = documents.unionByName(m)
    return home, robots, sitemap_urls(documents).select("sitemap_url", "kind", "ord", "loc")


@query
def discover_site(spark, d):
    """Whole discoveries, with each outcome: hubs, moved origins, both rounds, indexes, robots flags, failure codes."""
    home, robots, documents = made_sites(spark, d)
    found = discovery.discover_sites(home, robots, documents, "ExampleBot")
    return found.select("page_id", "origin", "hub_url", F.col("round").cast("long").alias("round"), F.array_join("members", " ").alias("members"), F.col("post").cast("long").alias("post"), "url", "allowed", "crawl_delay", "error_code")


@query
def discovery_report(spark, d):
    """What a discovery tells whoever asked for it, line by line."""
    return report.lines(discovery.discover_sites(*made_sites(spark, d), "ExampleBot")).select("page_id", F.col("line").cast("long").alias("line"), "text")


@query
def site_hubs(spark, d):
    """The hub of every homepage that answers, by its best link or its entered path."""
    home, _, _ = made_sites(spark, d)
    live = home.where("status = 200")
    return discovery.find_hub(html.anchors(live), live.select("page_id", "entered_url"))


@query
def inferred_posts(spark, d):
    """Posts of sites without a hub: a folder of a blog word, one that most URLs share, none, a date, a language."""
    section = _pick("site", ["'news'", "'p'", "CAST(k % 7 AS STRING)", "'2024'", "'fr'"])
    p = A.table(spark, d, "part").selectExpr("p_partkey AS k", "p_partkey % 5 AS site", "replace(p_name, ' ', '-') AS slug")
    u = p.selectExpr("'shop' || site || '.example' AS site", "k AS ord", f"'https://shop' || site || '.example/' || {section} || '/' || slug || '-' || k AS loc")
    sites = u.select("site", F.lit(None).cast("string").alias("hub_path"), F.lit(False).alias("posts_only")).distinct()
    return discovery.select_posts(u, sites).select("site", F.col("post").cast("long").alias("post"), "url")


@query
def whole_crawls(spark, d):
    """From homepages to results: sites discovered, their posts answered, pages analysed, and what each client is told.

    The answer to a post follows from its place: some are missing, some are refused, one kind is no page.
    """
    found = cut(discovery.discover_sites(*made_sites(spark, d), "ExampleBot"))
    posts = found.where("url is not null").select(F.xxhash64("url").alias("page_id"), F.col("origin").alias("site"), "url", F.col("post").cast("int").alias("position"), "allowed")
    page = F.concat(F.lit("<html lang=en><title>Post "), F.col("position").cast("string"), F.lit(" of a shop that sells tea</title><article><h1>Tea</h1><p>"), F.expr("repeat('green tea is good ', position * 30)"), F.lit("</p></article></html>"))
    status = F.when(F.col("position") % 7 == 3, 404).when(F.col("position") % 5 == 0, 429).otherwise(200)
    kind = F.when(F.col("position") == 9, "image/png").otherwise("text/html")
    answers = posts.where("allowed").select("url", F.col("url").alias("final_url"), status.alias("status"), kind.alias("content_type"), F.lit(None).cast("string").alias("x_robots"), F.lit(None).cast("string").alias("mitigated"), F.encode(page, "UTF-8").alias("body"), F.lit(5).alias("elapsed_ms"), F.lit(None).cast("string").alias("error"))
    return crawl.crawl_results(found, crawl.analyse_crawl(posts, answers))


# --- dates, pages of lists, limits


@query
def local_today(spark, d):
    """The day it is in each zone at an instant."""
    c = A.table(spark, d, "customer").select("c_custkey", F.timestamp_seconds(F.lit(1704067200) + F.col("c_custkey") * 3700).alias("now"))
    return c.select("c_custkey", *[dates.today_in(F.col("now"), zone).alias(name) for name, zone in (("toronto", "America/Toronto"), ("tokyo", "Asia/Tokyo"), ("utc", "UTC"))])


@query
def history_spans(spark, d):
    """Days of history for as many pairs as a customer has, pauses between requests, and last pages of lists."""
    n = F.col("c_custkey") % 400
    delay = F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 10).cast("double") / 2)
    return A.table(spark, d, "customer").select("c_custkey", dates.history_days(n, 50_000).alias("days"), state.polite_delay_ms(delay).alias("pause_ms"), reads.last_page(n).alias("last_page"))


@query
def paging_checks(spark, d):
    """Which requests for a page of a list are valid, the search text that counts, and how others are answered."""
    o = A.table(spark, d, "orders").selectExpr("o_orderkey AS k", f"{_pick('o_orderkey', ['1', '0', '3', 'NULL', '-2', '1', '7'])} AS page", f"{_pick('o_orderkey', ['20', '0', '100', '101', 'NULL'])} AS page_size", f"{_pick('o_orderkey', ['NULL', chr(39) + '  tea ' + chr(39), chr(39) + ' ' + chr(39), 'repeat(o_orderpriority, 20)', 'repeat(' + chr(39) + 'x' + chr(39) + ', 200)', 'repeat(' + chr(39) + 'é' + chr(39) + ', 201)'])} AS q")
    error = reads.paging_error(F.col("page"), F.col("page_size"), F.col("q"))
    status = F.when(error.isNotNull(), InvalidRequest.status).otherwise(200)
    return o.select(F.col("k").alias("o_orderkey"), F.when(error.isNull(), F.nullif(F.trim("q"), F.lit(""))).alias("q"), error.alias("error"), status.cast("long").alias("status"))


@query
def uuid_ids(spark, d):
    """Texts that have the form of an id, and some that don't."""
    c = A.table(spark, d, "customer").select("c_custkey", F.expr(_pick("c_custkey", ["format_string('%08x-0000-4000-8000-%012x', c_custkey, c_custkey)", "format_string('%08X-1111-1111-BBBB-%012X', c_custkey, c_custkey)", "format_string('%08x-0000-9000-8000-%012x', c_custkey, c_custkey)", "format_string('%08x00004000a000%012x', c_custkey, c_custkey)", "CAST(c_custkey AS STRING)", "NULL"])).alias("x"))
    return c.select("c_custkey", reads.is_uuid(F.col("x")).alias("valid"))


@query
def health(spark, d):
    """Whether each of the given tables can be read, how many rows it has, and one that isn't there."""
    names = ["nation", "customer", "orders", "lineitem", "part", "events", "documents", "pages", "nowhere"]
    return crawl.health(spark, {n: partial(A.table, spark, d, n) for n in names})


@query
def empty_relations(spark, d):
    """Every relation of the schema as a new store has it, loaded with the given tables where they hold any of it."""
    t = A.read_tables(spark, d)
    users = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lower("n_name"), F.lit("@shop.example")).alias("email"))
    given = {"users": users, "clients": t.clients, "pages": t.pages, "keywords": t.keywords, "page_keywords": t.page_keywords, "seo_issues": t.seo_issues, "rank_snapshots": t.rank_snapshots}
    at = f"{shared_dir(spark).rstrip('/')}/relations-{uuid.uuid4().hex}"
    try:
        stored = schema.migrate(given, at)
        return spark.createDataFrame([(name, len(rows.columns), rows.count()) for name, rows in stored.items()], "name string, n_columns long, n_rows long")
    finally:
        remove(spark, at)


# --- bulk loads, users, clients, sessions, analyses


@query
def bulk_rows(spark, d):
    """Captures that come as one array a column, zipped back to rows."""
    e = A.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("r"))
    arrays = e.select("user_id", *[F.col("r").getField(c).alias(c) for c in ("event_id", "event_type", "value")])
    return crawl.rows_from_arrays(arrays, "event_id", "event_type", "value")


@query
def user_upserts(spark, d):
    """Known users get a new password by their address, however it is written; others are added."""
    c = A.table(spark, d, "customer").selectExpr("c_custkey AS k")
    users = c.where("k % 3 <> 0").selectExpr("CAST(k AS STRING) AS id", "'user' || k || '@shop.example' AS email", "'old' AS password_hash", "'Asia/Tokyo' AS timezone")
    rows = c.where("k % 3 <> 1").selectExpr("'new' || k AS id", "' User' || k || '@SHOP.example ' AS email", "'fresh' AS password_hash", "'America/Toronto' AS timezone")
    return state.upsert_users(users, rows)


@query
def client_inserts(spark, d):
    """Clients that are new to their user, by site, of valid addresses only."""
    c = A.table(spark, d, "customer").selectExpr("c_custkey AS k", "c_nationkey AS user_id")
    known = c.where("k % 4 = 0").selectExpr("user_id", "'shop' || k || '.example' AS site_key")
    form = _pick("k", ["'https://www.shop' || k || '.example/'", "'http://shop' || k || '.example'", "'shop' || k", "'https://SHOP' || k || '.example./x?y'", "'https://shop' || k || '.example'"])
    return state.insert_clients(known, c.selectExpr("user_id", "'Shop ' || k AS name", f"{form} AS website_url"))


def _sessions(spark, d):
    s = A.table(spark, d, "events").select(text.token_id(F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("id"), "user_id", (F.col("ts").cast("timestamp") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    users = A.table(spark, d, "events").select(F.col("user_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@shop.example")).alias("email")).distinct()
    return s, users, F.lit("2024-01-20 00:00:00").cast("timestamp")


@query
def live_sessions(spark, d):
    """All sessions that are not over, with their users; those past their half are renewed."""
    return state.live_sessions(*_sessions(spark, d)).select("id", "email", dates.iso_utc(F.col("expires_at")).alias("expires_at"), "renewed")


@query
def token_session(spark, d):
    """The session of the newest token."""
    s, users, now = _sessions(spark, d)
    newest = A.table(spark, d, "events").agg(F.max("event_id")).first()[0]
    return state.active_session(s, users, f"t{newest}", now).select("email", "renewed")


@query
def session_purge(spark, d):
    s, _, now = _sessions(spark, d)
    return state.purged_count(s, now)


@query
def save_analysis(spark, d):
    """An analysis stored: terms with their ids, pairs that keep theirs, issues. One row a stored row."""
    old_terms = A.table(spark, d, "part").where("p_partkey % 3 = 0").groupBy(F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("id")).select("id", "term")
    li = A.table(spark, d, "lineitem").join(A.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("page_id"), "p_name", "l_linenumber", "l_quantity", "l_returnflag")
    pairs = li.where("l_linenumber <= 2").join(old_terms, F.col("p_name") == F.col("term")).groupBy("page_id", F.col("id").alias("keyword_id")).agg(F.max("l_quantity").alias("score"))
    pairs = pairs.withColumn("id", F.col("page_id") * 100_000 + F.col("keyword_id"))
    picks = li.where("l_linenumber > 1").groupBy("page_id", F.concat("p_name", F.when(F.col("page_id") % 5 == 0, " set").otherwise("")).alias("term")).agg(F.max("l_quantity").alias("score"))
    done = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), (F.col("o_orderstatus") != "F").alias("fetched")).where("page_id % 4 <> 0")
    old_issues = li.where("l_returnflag = 'R'").select("page_id", F.lit("noindex").alias("code"), F.lit("error").alias("severity")).distinct()
    new_issues = done.select("page_id", F.when(F.col("fetched"), "thin_content").otherwise("http_error").alias("code"), F.when(F.col("fetched"), "warning").otherwise("error").alias("severity"))
    terms, stored, found = state.save_analysis(old_terms, pairs, old_issues, picks.join(done.where("fetched"), "page_id", "left_semi"), new_issues, done)
    names = cut(terms)
    rows = names.select(F.lit("term").alias("kind"), F.lit(None).cast("long").alias("page_id"), "id", F.col("term").alias("name"), F.lit(None).cast("double").alias("score"))
    rows = rows.unionByName(stored.join(names.withColumnRenamed("id", "keyword_id"), "keyword_id").select(F.lit("pair").alias("kind"), "page_id", "id", F.col("term").alias("name"), "score"))
    return rows.unionByName(found.select(F.lit("issue").alias("kind"), "page_id", F.lit(None).cast("long").alias("id"), F.col("code").alias("name"), F.lit(None).cast("double").alias("score")))


@query
def crawl_resume(spark, d):
    """After a restart: crawls without a live owner wait again, oldest client first."""
    from siltstone.plans.catalog import _clients

    _, queue = state.resume(_clients(spark, d), F.timestamp_seconds(F.lit(500000)))
    return state.numbered(queue, ["created_at", "id"], "place").select("id", "place")


# --- details and series


def _uuid(c: str) -> F.Column:
    return F.format_string("%08x-0000-4000-8000-000000000000", F.col(c).cast("int"))


def _detail_tables(spark, d) -> reads.Tables:
    """The read relations with UUIDs for pages."""
    t = A.read_tables(spark, d)
    of_page = lambda df: df.withColumn("page_id", _uuid("page_id"))
    return reads.Tables(t.clients, t.pages.withColumn("id", _uuid("id")), of_page(t.page_keywords), t.keywords, of_page(t.seo_issues), t.rank_snapshots)


def _shown(found: DataFrame) -> DataFrame:
    keys = F.array_join(F.transform("keywords", lambda k: F.concat_ws(":", k["id"].cast("string"), k["term"], k["score"].cast("string"), F.array_join(k["sources"], ","), F.coalesce(k["position"].cast("string"), F.lit("-")), F.coalesce(k["date"], F.lit("-")))), ";")
    codes = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["severity"], i["code"])), ";")
    return found.select("id", "url", "client_name", "fetched_at", F.coalesce(keys, F.lit("")).alias("keywords"), F.coalesce(codes, F.lit("")).alias("issues"))


@query
def page_details(spark, d):
    """The details of all pages of an owner."""
    t = _detail_tables(spark, d)
    return _shown(reads.page_details(t, reads.matching_pages(t, OWNER), ZONE))


@query
def page_detail(spark, d):
    """One page of an owner by its id."""
    t = _detail_tables(spark, d)
    first = reads.matching_pages(t, OWNER).agg(F.min("id")).first()[0]
    return _shown(reads.page_detail(t, OWNER, first, ZONE))


@query
def page_detail_refused(spark, d):
    """A page of somebody else, and a text that is no id: no row."""
    t = _detail_tables(spark, d)
    other = reads.matching_pages(t, OWNER + 1).agg(F.min("id")).first()[0]
    return _shown(reads.page_detail(t, OWNER, other, ZONE).unionByName(reads.page_detail(t, OWNER, "17", ZONE)))


@query
def chart_series(spark, d):
    """The keywords that a page's chart shows at first."""
    k = A.read_tables(spark, d).page_keywords
    return ranks.default_series(k, "page_id", ["rank_order", "id"]).select("page_id", "id")


@query
def chart_ranges(spark, d):
    """The ranges on offer on the day of each owner's last capture, and the captures in each."""
    shots = A.snapshots(spark, d).select("user_id", F.to_date("captured_at").alias("day"))
    last = shots.groupBy("user_id").agg(F.max("day").alias("today")).select("user_id", F.inline(ranks.range_spans(F.col("today"))))
    found = last.join(shots.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n")), "user_id").where("day BETWEEN first AND last")
    return found.groupBy("user_id", F.col("days").cast("long").alias("days"), "first", "last").agg(F.sum("n").alias("captures"))


@query
def seeded_accounts(spark, d):
    """Accounts seeded twice over: users by address, and the clients that they gain."""
    c = A.table(spark, d, "customer").selectExpr("c_custkey AS k")
    users = c.where("k % 2 = 0").selectExpr("CAST(k AS STRING) AS id", "'user' || k || '@shop.example' AS email", "'old' AS password_hash", "'UTC' AS timezone")
    clients = c.where("k % 6 = 0").selectExpr("CAST(k AS STRING) AS user_id", "'shop' || k || '.example' AS site_key")
    accounts = c.selectExpr("'n' || k AS id", "'USER' || k || '@shop.example' AS email", "'fresh' AS password_hash", "'UTC' AS timezone", "'Shop ' || k AS name", "'https://www.shop' || k || '.example' AS website_url")
    after, gained = seed.seed_accounts(users, clients, accounts)
    return after.select("id", "email", "password_hash", F.lit(None).cast("string").alias("site_key")).unionByName(gained.select(F.col("user_id").alias("id"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("password_hash"), "site_key"))


@query
def seeded_ranks(spark, d):
    """A year of history and more for all pairs of an owner's pages, but for the days there are."""
    t = A.read_tables(spark, d)
    pages = reads.matching_pages(t, OWNER).select(*t.pages.columns)
    own = cut(t.page_keywords.join(pages.select(F.col("id").alias("page_id")), "page_id", "left_semi"))
    clients = t.clients.join(pages.join(own, F.col("page_id") == pages.id, "left_semi").select(F.col("client_id").alias("id")).distinct(), "id", "left_semi")
    made = seed.seed_ranks(reads.Tables(clients, pages, own, t.keywords, t.seo_issues, t.rank_snapshots), date(1998, 12, 31))
    return made.groupBy("page_keyword_id").agg(F.count(F.lit(1)).alias("days"))


@query
def analysed_crawl(spark, d):
    """Whole crawls: pages, issues of what failed, and outcomes, where sites refuse, fail, forbid or answer with something else."""
    p = made_pages(spark, d).withColumn("k", F.col("page_id")).selectExpr("*", "page_id % 5 = 2 AND floor(page_id / 5) % 10 IN (3, 4, 5) OR page_id % 5 = 3 AND floor(page_id / 5) % 4 = 1 AS refused")
    p = p.selectExpr("*", "CASE WHEN k % 23 = 0 THEN 'timeout' END AS error", "CASE WHEN k % 23 = 0 THEN NULL WHEN refused THEN 403 WHEN k % 17 = 0 THEN 404 WHEN k % 19 = 0 THEN 500 ELSE 200 END AS status", "CASE WHEN k % 29 = 0 THEN 'application/pdf' WHEN k % 31 <> 0 THEN 'text/html; charset=utf-8' END AS content_type", "CASE WHEN k % 37 = 0 THEN 'challenge' END AS mitigated")
    entries = p.select("page_id", "site", "url", F.col("page_id").cast("int").alias("position"), (F.col("k") % 13 != 0).alias("allowed"))
    answers = p.where("k % 13 <> 0").select("url", "url", "status", "content_type", "x_robots", "mitigated", F.when(F.col("error").isNull(), F.encode("html", "UTF-8")).alias("body"), F.lit(7).alias("elapsed_ms"), "error").toDF("url", "final_url", "status", "content_type", "x_robots", "mitigated", "body", "elapsed_ms", "error")
    c = crawl.analyse_crawl(entries, answers)
    text_, none = (lambda x: F.col(x).alias("value")), F.lit(None).cast("string")
    pages = c.pages.select(F.lit("page").alias("kind"), "page_id", "site", text_("fetch_status"), F.col("title").alias("more"), F.col("http_status").cast("long").alias("number"))
    failed = c.issues.where("code = 'http_error'").select(F.lit("issue").alias("kind"), "page_id", none.alias("site"), text_("message"), F.col("severity").alias("more"), F.lit(None).cast("long").alias("number"))
    ends = c.outcomes.select(F.lit("outcome").alias("kind"), F.lit(None).cast("long").alias("page_id"), "site", F.concat_ws(" ", "status", "error_code").alias("value"), F.col("message").alias("more"), F.col("analysed").alias("number"))
    return pages.unionByName(failed).unionByName(ends)


@query
def stream_counts(spark, d):
    """Captures by day, counted by a stream that reads the table once and stops."""
    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    kind = A.table(spark, d, "events").schema
    stream = A.as_snapshots(spark.readStream.schema(kind).parquet(f"{d}/events*.parquet"))  # a stream reads folders or patterns
    counts = update_counts(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    try:
        counts.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{at}/out")).start().awaitTermination()
        return cut(spark.read.parquet(f"{at}/out").select(dates.iso_utc(F.col("start")).alias("start"), "n", "unranked"))
    finally:
        remove(spark, at)

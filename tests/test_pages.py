"""Page facts, rules and phrase picks on small fixtures."""

from pyspark.sql import functions as F

from siltstone.operators import issues, keywords
from siltstone.sources import html

FULL = """<!doctype html><html lang="en"><head><title> Keyword research guide | Acme </title>
<meta NAME="Description" content="All about  keyword research."><meta name="robots" content="Index, NoFollow"><link rel="Canonical" href="/guide#top">
<script type="application/ld+json">{"@graph": [{"@type": ["Article", 3], "keywords": "seo tools, , links"}]}</script><script type="application/ld+json">{broken</script>
<link rel="stylesheet" href="http://a.com/s.css"></head><body><nav>Menu</nav><article><h1>Keyword research guide</h1><h2>Why it matters</h2><p>Good&nbsp;text &amp; more<p>Next<br>line<ul><li>one<li>two</ul>
<img src="http://a.com/x.png"><img src="y.png" alt=""><img><script src="https://a.com/z.js"></script><footer>gone</footer></article></body></html>"""


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


def test_facts(spark):
    [r] = html.page_facts(pages(spark, (1, "https://a.com/guide", FULL)).withColumn("x_robots", F.lit("NoIndex"))).collect()
    assert (r.title, r.meta_description, r.h1s, r.headings) == ("Keyword research guide | Acme", "All about keyword research.", ["Keyword research guide"], ["Why it matters"])
    assert (r.canonical, r.robots, r.lang) == ("/guide#top", "index, nofollow,noindex", "en")
    assert (r.jsonld_types, r.jsonld_keywords) == (["Article"], ["seo tools", "links"])
    assert (r.images_total, r.images_missing_alt, r.insecure_resources, r.script_count) == (3, ["http://a.com/x.png", "(no src)"], 2, 1)
    assert r.main_text == "Keyword research guide Why it matters Good text & more Next line one two"
    [r] = html.page_facts(pages(spark, (2, "http://a.com/", None))).collect()
    assert (r.title, r.main_text, r.word_count, r.insecure_resources) == (None, "", 0, 0)


def codes(spark, *rows, site="a.com"):
    facts = html.page_facts(pages(spark, *rows)).withColumn("site", F.lit(site))
    out = {}
    for r in issues.find_issues(facts).collect():
        out.setdefault(r.page_id, {})[r.code] = r
    return out


def test_rules(spark):
    long_text = "word " * 60
    found = codes(
        spark,
        (1, "https://a.com/guide", FULL),
        (2, "https://a.com/2", f"<title>{'x' * 30}</title><meta name=description content=d><link rel=canonical href='https://a.com/2#f'><meta name=robots content='googlebot: none'><h1>a</h1><h1>b</h1><main>{long_text}</main>"),
        (3, "https://a.com/3", f"<title>{'x' * 30}</title><body><script src=a></script><img src=a>few words</body>"),
        (4, "https://a.com/4", "<body>few</body>"),
    )
    assert set(found[1]) == {"title_length", "images_missing_alt", "mixed_content", "client_rendered"}
    assert found[1]["images_missing_alt"].message == "2 of 3 images have no alt text" and found[1]["images_missing_alt"].details == '{"images":["http://a.com/x.png","(no src)"]}'
    assert set(found[2]) == {"noindex", "title_duplicate", "h1_multiple", "thin_content"}
    assert found[2]["title_duplicate"].message == "2 crawled pages share this title"
    assert set(found[3]) == {"title_duplicate", "meta_description_missing", "h1_missing", "canonical_missing", "client_rendered", "images_missing_alt"}
    assert set(found[4]) == {"title_missing", "meta_description_missing", "h1_missing", "canonical_missing"}
    other = codes(spark, (1, "https://a.com/x", "<link rel=canonical href='https://b.com/'>"))
    assert other[1]["canonical_mismatch"].details == '{"canonical":"https://b.com/"}'


def test_counts_and_failures(spark):
    facts = html.page_facts(pages(spark, (1, "https://a.com/", "<body></body>"), (2, "https://a.com/guide", FULL))).withColumn("site", F.lit("a.com"))
    rows = {r.page_id: (r.issue_count, r.error_count) for r in issues.issue_counts(facts, issues.find_issues(facts)).collect()}
    assert rows == {1: (4, 2), 2: (4, 0)}
    f = issues.fetch_failure_issues(spark.createDataFrame([(1, 404, "x"), (2, None, "timed out")], "page_id long, status int, reason string")).orderBy("page_id").collect()
    assert [r.message for r in f] == ["URL listed in the sitemap returns HTTP 404", "URL listed in the sitemap could not be fetched: timed out"]


def article(title, h1, body):
    return f"<html><head><title>{title}</title></head><body><nav>x</nav><main><article><h1>{h1}</h1>{body}</article></main></body></html>"


def test_picks(spark):
    para = "<p>Keyword research finds what people search. Keyword research takes time. Acme loves keyword research.</p>" * 2
    other = "<p>Link building earns links. Link building is slow. Acme sells link building.</p>" * 2
    rows = [
        (1, "https://acme.com/blog/keyword-research", article("Keyword research | Acme", "Keyword research", para)),
        (2, "https://acme.com/blog/link-building", article("Link building | Acme", "Link building", other)),
        (3, "https://acme.com/blog/tea", article("Tea and cake | Acme", "Tea", "<p>Tea.</p>")),
    ]
    facts = html.page_facts(pages(spark, *rows)).withColumn("site", F.lit("acme.com"))
    assert [r.word for r in keywords.brand_words(facts).collect()] == ["acme"]
    picks = {}
    for r in keywords.keyword_picks(facts).orderBy("page_id", "rank_order").collect():
        picks.setdefault(r.page_id, []).append(r)
    assert picks[1][0].term == "keyword research" and picks[2][0].term == "link building"
    assert picks[1][0].sources == ["title", "h1", "slug", "intro", "body"]
    for rows in picks.values():
        assert [r.rank_order for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 8
        assert not any("acme" in r.term for r in rows)
        padded = [f" {r.term} " for r in rows]
        assert not any(a in b for i, a in enumerate(padded) for j, b in enumerate(padded) if i != j)


def test_anchors(spark):
    rows = html.anchors(pages(spark, (1, "https://a.com/", "<header><nav><a href='/blog'> The\n Blog </a></nav></header><a href=x>y</a><a>none</a>"))).orderBy("ord").collect()
    assert [(r.href, r.text, r.in_nav) for r in rows] == [("/blog", "the blog", True), ("x", "y", False)]


def test_site_queries_read_whole_pages(spark, tmp_path):
    """Metadata, media and main text outside an article reach the registered queries."""
    from siltstone.plans import analogues, catalog

    full = '''<html lang="en"><head><title>Full page</title><meta name="description" content="copper kettle stand"><meta name="robots" content="NOINDEX">
<link rel="canonical" href="https://other.example/x"><script type="application/ld+json">{"@type": "Product", "keywords": "walnut tray"}</script></head>
<body><h1>One</h1><h2>Enamel bread bin</h2><main>five words are in here<img src="http://a.example/i.png"></main></body></html>'''
    rows = [(1, "https://shop.example/x", full), (2, "https://shop.example/y", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r.page_id: r.asDict() for r in analogues.site_facts(spark, str(tmp_path)).drop("site", "word_count").collect()}
    assert found == {i: {"page_id": i, "url": u} | html.facts_of(h, u) for i, u, h in rows}
    codes = {r.code for r in catalog.queries()["page_issues"](spark, str(tmp_path)).where("page_id = 1").collect()}
    assert {"noindex", "canonical_mismatch", "images_missing_alt", "mixed_content"} <= codes
    assert not codes & {"meta_description_missing", "canonical_missing"}
    terms = {(r.term, r.sources) for r in catalog.queries()["keyword_candidates"](spark, str(tmp_path)).where("page_id = 1").collect()}
    assert {("walnut tray", "schema"), ("enamel bread bin", "heading")} <= terms and any(t == "copper kettle stand" for t, _ in terms)


def test_phrase_queries_compose(spark, tmp_path):
    """Decomposed, full-width and ligature spellings of a phrase are one term in the registered queries."""
    from siltstone.plans import catalog

    spellings = ["café finesse", "cafe\u0301 finesse", "\uff43\uff41\uff46\u00e9 \ufb01nesse"]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(spellings)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    page = "<html><head><title>{0}</title></head><body><article><h1>{0}</h1></article></body></html>"
    rows = [(i, f"https://shop.example/{i}", page.format(t)) for i, t in enumerate(spellings)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.term, r.n) for r in run("doc_phrases")} == {(i, t, 1) for i in range(3) for t in ("café", "finesse", "café finesse")}
    assert {(r.term, r.df) for r in run("term_document_frequency")} == {(t, 3) for t in ("café", "finesse", "café finesse")}
    assert {r.term for r in run("term_idf")} == {"café", "finesse", "café finesse"}
    assert {r.term for r in run("keyword_candidates")} == {"café", "finesse", "café finesse"}

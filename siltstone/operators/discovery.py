"""Finding a site's posts: its hub, its sitemap families and their scores, and the posts in order.

All sites are worked on at once; what the walk of one site would fetch lazily is read from a table of sitemap documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.constants import BLOG_WORDS, CONVENTIONAL_SITEMAPS, FAMILIES_SAMPLED, MAX_INDEX_DEPTH, MAX_PARTS, MAX_SITEMAP_FETCHES, MIN_HUB_URLS, POST_LIMIT, SAMPLE_SIZE
from siltstone.functions.lineage import cut
from siltstone.functions.urls import LOCALE, family_key, has_locale, has_negative, has_positive, host, is_archive_or_file, is_article_shaped, is_subdomain, is_under, name_tokens, normalize_page_url, path, segments, site_key, strip_default_port
from siltstone.sources.html import anchors
from siltstone.sources.sitemap import robots_check, robots_sitemaps


def hub_link_scores(links: DataFrame, resolved: bool = True) -> DataFrame:
    """links(page_id, url, ord, href, text, in_nav) with target and score, for links that may lead to a blog."""
    target = normalize_page_url(F.col("href"), F.col("url") if resolved else None)
    found = links.withColumn("target", target).where("target is not null")
    sub = is_subdomain(host(F.col("target")), host(F.col("url")))
    p = path(F.col("target"))
    found = found.where(sub | ((site_key(host(F.col("target"))) == site_key(host(F.col("url")))) & (p != "/")))
    joined = F.array_join(segments(p), "/")
    score = F.when(F.col("text") == "blog", 4).when(F.col("text").isin(BLOG_WORDS), 3).when(joined.rlike("^[a-z]*-?blog$"), 2).when(sub & F.split(host(F.col("target")), r"\.")[0].isin(BLOG_WORDS), 2).otherwise(0)
    return found.withColumn("score", F.when(score > 0, score + F.col("in_nav").cast("int")).otherwise(0)).where("score > 0")


def find_hub(links: DataFrame, entered: DataFrame) -> DataFrame:
    """(page_id, hub_url) for entered(page_id, entered_url): an entered path wins outright, else the best link, the first of equals."""
    best = hub_link_scores(links).groupBy("page_id").agg(F.max_by("target", F.struct("score", -F.col("ord"))).alias("hub"))
    own = path(F.col("entered_url"))
    return entered.join(best, "page_id", "left").select("page_id", F.when(~own.isin("/", ""), normalize_page_url(F.col("entered_url"))).otherwise(F.col("hub")).alias("hub_url"))


def hub_sitemaps(origin: Column, hub_url: Column) -> Column:
    """The usual sitemap places within a hub's own path; none without a hub on the site below its root."""
    p = F.regexp_extract(hub_url, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    p = F.when(F.endswith(p, F.lit("/")), p).otherwise(F.concat(p, F.lit("/")))
    names = [x[1:] for x in CONVENTIONAL_SITEMAPS if not x.startswith("/blog/")]
    good = hub_url.isNotNull() & (site_key(host(hub_url)) == site_key(host(origin))) & (p != "/")
    return F.when(good, F.array(*[F.concat(origin, p, F.lit(n)) for n in names])).otherwise(F.array().cast("array<string>"))


def expand_indexes(start: DataFrame, documents: DataFrame, depth: int = MAX_INDEX_DEPTH) -> DataFrame:
    """(site, sitemap_url, ord): the candidates below start(site, sitemap_url, ord), indexes replaced by their children.

    documents(site, sitemap_url, kind, ord, loc). Of start only readable sitemaps count; children are candidates whether
    they can be read or not, as they are ranked by name first. A bounded number of levels; order is that of the walk.
    """
    kinds = documents.where("kind <> 'unknown'").select("sitemap_url", "kind").distinct()
    children = documents.where("kind = 'index'").where(F.col("loc").rlike(r"(?i)^https?://")).select(F.col("sitemap_url").alias("parent"), F.col("ord").cast("long").alias("child"), "loc")
    at = start.select("site", "sitemap_url", F.array(F.col("ord").cast("long")).alias("place"))
    out = None
    for level in range(depth + 1):
        known = at.join(kinds, "sitemap_url", "left" if level else "inner")
        index = F.coalesce(F.col("kind") == "index", F.lit(False))
        leaves = known.where(~index).select("site", "sitemap_url", "place")
        out = leaves if out is None else out.unionByName(leaves)
        if level == depth:
            break
        at = known.where(index).join(children, F.col("sitemap_url") == F.col("parent")).select("site", F.col("loc").alias("sitemap_url"), F.array_append("place", F.col("child")).alias("place"))
    first = out.groupBy("site", "sitemap_url").agg(F.min("place").alias("place"))
    return first.select("site", "sitemap_url", F.row_number().over(Window.partitionBy("site").orderBy("place", "sitemap_url")).alias("ord"))


def name_score(url: Column, hub_path: Column) -> Column:
    tokens, p = name_tokens(url), path(url)
    under = F.coalesce((hub_path != "/") & is_under(p, hub_path), F.lit(False))
    return F.when(under, 40).otherwise(0) + F.when(has_positive(tokens), 15).otherwise(0) - F.when(has_negative(tokens), 30).otherwise(0) - F.when(has_locale(p), 10).otherwise(0)


def family_scores(sitemaps: DataFrame, documents: DataFrame, hubs: DataFrame, sample: int | None = SAMPLE_SIZE) -> DataFrame:
    """(site, family, members, first_url, prior, n, evidence, score) of the families of each site, best by name first.

    sitemaps(site, sitemap_url, ord), documents as above, hubs(site, hub_url or null). A family's sample is that of its
    first member, and of further ones while a known hub shows too few URLs. Without evidence of a blog a family has no
    score. Of a sitemap the first sample locations count, as many as a walk fetches; with None all of them.
    """
    hubs = hubs.select("site", path(F.col("hub_url")).alias("hub_path")).withColumn("hub_path", F.when(F.col("hub_path") != "", F.col("hub_path")))
    fam = sitemaps.groupBy("site", family_key(F.col("sitemap_url")).alias("family")).agg(F.array_sort(F.collect_list(F.struct("ord", "sitemap_url"))).alias("m"))
    fam = fam.select("site", "family", F.transform("m", lambda x: x["sitemap_url"]).alias("members"), F.element_at("m", 1)["ord"].alias("ord")).join(hubs, "site", "left")
    fam = fam.withColumn("first_url", F.element_at("members", 1)).withColumn("prior", name_score(F.col("first_url"), F.col("hub_path")))
    best = Window.partitionBy("site").orderBy(F.desc("prior"), "ord")
    fam = fam.withColumn("place", F.row_number().over(best)).where(F.col("place") <= FAMILIES_SAMPLED)
    if sample is not None:
        documents = documents.where(F.col("ord") < sample)
    urls = documents.select("sitemap_url", "ord", path(F.col("loc")).alias("p"), site_key(host(F.col("loc"))).alias("key"), "kind")
    parts = fam.select("site", "family", "hub_path", F.posexplode(F.slice("members", 1, MAX_PARTS)).alias("part", "sitemap_url"))
    read = parts.join(urls.withColumnRenamed("ord", "at"), "sitemap_url").where((F.col("key") == F.col("site")) & ((F.col("part") == 0) | (F.col("kind") == "urlset")))
    hub_known = F.coalesce(F.col("hub_path") != "/", F.lit(False))
    under = F.coalesce(hub_known & is_under(F.col("p"), F.col("hub_path")) & (F.col("p") != F.col("hub_path")), F.lit(False)).cast("int")
    by_part = read.groupBy("site", "family", "part").agg(F.sum(under).alias("u"), F.count(F.lit(1)).alias("c"), F.count_if(is_article_shaped(F.col("p"))).alias("a"), F.max(F.coalesce(F.col("p") == F.col("hub_path"), F.lit(False))).alias("h"))
    grid = parts.select("site", "family", "hub_path", "part").join(by_part, ["site", "family", "part"], "left").na.fill(0, ["u", "c", "a"])
    before = F.coalesce(F.sum("u").over(Window.partitionBy("site", "family").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = grid.withColumn("taken", (F.col("part") == 0) | (hub_known & (before < MIN_HUB_URLS)))
    n = grid.where("taken").groupBy("site", "family").agg(F.sum("u").alias("under"), F.sum("c").alias("n"), F.sum("a").alias("shaped"), F.max("h").alias("has_hub"), F.count(F.lit(1)).alias("parts"))
    none_negative = ~has_negative(name_tokens(F.col("first_url")))
    first = grid.where("part = 0").select("site", "family", F.col("u").alias("u0"), F.col("c").alias("c0"), F.col("a").alias("a0"), F.col("h").alias("h0"))
    fam = fam.join(n, ["site", "family"]).join(first, ["site", "family"])
    fam = fam.withColumns({k: F.when(none_negative, F.col(a)).otherwise(F.col(b)) for k, a, b in (("under", "under", "u0"), ("n", "n", "c0"), ("shaped", "shaped", "a0"), ("has_hub", "has_hub", "h0"))})
    hub = F.coalesce(F.col("hub_path") != "/", F.lit(False))
    share = lambda x: F.col(x) / F.greatest(F.col("n"), F.lit(1))
    by_hub = hub & (is_under(path(F.col("first_url")), F.col("hub_path")) | (F.col("under") >= MIN_HUB_URLS) | (share("under") >= 0.5))
    evidence = (F.col("n") > 0) & (has_positive(name_tokens(F.col("first_url"))) | F.coalesce(by_hub, F.lit(False)) | (share("shaped") >= 0.6))
    content = F.when(hub & (share("under") >= 0.5), 40).otherwise(0) + F.when(hub & F.coalesce("has_hub", F.lit(False)), 40).otherwise(0) + F.when(share("shaped") >= 0.6, 10).otherwise(0) + F.least(F.lit(10.0), F.log2(F.col("n") + 1))
    return fam.select("site", "family", "members", "first_url", "prior", "place", "hub_path", "n", evidence.alias("evidence"), F.when(evidence, F.col("prior") + content).alias("score"))


def section_shares(urls: DataFrame) -> DataFrame:
    """(site, segment, n, share): first segments of the paths of urls(site, url) that have two segments or more."""
    s = segments(path(F.col("url")))
    deep = urls.select("site", s[0].alias("segment"), F.size(s).alias("k")).where("k >= 2")
    n = deep.groupBy("site", "segment").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("site")))


def infer_section(urls: DataFrame, limit: int = POST_LIMIT) -> DataFrame:
    """(site, section): a blog-word folder with enough URLs, else a folder that most URLs share; no row for neither.

    urls(site, url, ord). Of folders with as many URLs the first seen counts. A language is no section, a number neither.
    """
    s = segments(path(F.col("url")))
    deep = urls.select("site", "ord", s[0].alias("segment"), F.size(s).alias("k")).where("k >= 2")
    n = deep.groupBy("site", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    total = n.groupBy("site").agg(F.sum("n").alias("total"))
    n = n.where(~F.col("segment").rlike(LOCALE))
    key = F.struct("n", -F.col("first"))
    blog = (F.col("segment").isin(BLOG_WORDS)) & (F.col("n") >= limit / 3)
    best = n.groupBy("site").agg(F.max_by(F.when(blog, F.col("segment")), F.when(blog, key)).alias("blog"), F.max_by(F.struct("segment", "n"), key).alias("top")).join(total, "site")
    top = F.when(~F.col("top.segment").rlike(r"^\d+$") & (F.col("top.n") >= limit / 3) & (F.col("top.n") / F.col("total") >= 0.5), F.col("top.segment"))
    return best.select("site", F.concat(F.lit("/"), F.coalesce("blog", top), F.lit("/")).alias("section")).where("section is not null")


def select_posts(urls: DataFrame, sites: DataFrame, limit: int = POST_LIMIT) -> DataFrame:
    """(site, post, url): up to limit posts of each site in sitemap order.

    urls(site, ord, loc), sites(site, hub_path or null, posts_only). Normal forms are counted once; the hub, listings,
    files and other sites go. Where enough URLs lie under the hub or section, only these stay.
    """
    u = urls.select("site", "ord", normalize_page_url(F.col("loc")).alias("url")).where("url is not null")
    own = u.where(site_key(host(F.col("url"))) == F.col("site"))
    inferred = infer_section(own, limit)
    s = sites.join(inferred, "site", "left")
    hub = F.coalesce(F.col("hub_path") != "/", F.lit(False))
    s = s.withColumn("section", F.when(hub, F.col("hub_path")).when(F.col("posts_only"), F.lit(None)).otherwise(F.col("section")))
    s = s.where(F.col("hub_path").isNotNull() | F.col("posts_only") | F.col("section").isNotNull())
    u = u.join(s, "site").withColumn("p", path(F.col("url")))
    under = F.coalesce(is_under(F.col("p"), F.col("section")), F.lit(False))
    n_under = u.groupBy("site").agg(F.count_if(under & (F.col("p") != F.col("section"))).alias("n_under"))
    u = u.join(n_under, "site").where(site_key(host(F.col("url"))) == F.col("site"))
    u = u.groupBy("site", "url", "p", "hub_path", "section", "n_under").agg(F.min("ord").alias("ord"))
    good = (F.size(segments(F.col("p"))) > 0) & ~F.coalesce(F.col("p") == F.col("hub_path"), F.lit(False)) & ~F.coalesce(F.col("p") == F.col("section"), F.lit(False)) & ((F.col("n_under") < limit / 3) | under) & ~is_archive_or_file(F.col("p"))
    w = Window.partitionBy("site").orderBy("ord")
    return u.where(good).withColumn("post", F.row_number().over(w)).where(F.col("post") <= limit).select("site", "post", "url")


def first_readable(places: DataFrame, documents: DataFrame) -> DataFrame:
    """The first of the places(site, round, sitemap_url, ord) of each site and round that can be read: guesses need one answer."""
    kinds = documents.where("kind <> 'unknown'").select("sitemap_url").distinct()
    best = places.join(kinds, "sitemap_url", "left_semi").groupBy("site", "round").agg(F.min_by(F.struct("sitemap_url", "ord"), "ord").alias("p"))
    return best.select("site", "round", "p.*")


def sitemap_rounds(origins: DataFrame, listed: DataFrame, documents: DataFrame) -> DataFrame:
    """(site, round, sitemap_url, ord): where to look for the sitemaps of origins(site, origin, hub_url).

    First what robots.txt lists, listed(site, sitemap_url, ord), of the site itself and up to a number, with the first
    readable usual place below the hub; then the first readable usual place of the site.
    """
    own = listed.join(origins.select("site"), "site").where(F.col("sitemap_url").rlike(r"(?i)^https?://") & (site_key(host(F.col("sitemap_url"))) == F.col("site")))
    nth = F.row_number().over(Window.partitionBy("site").orderBy("ord"))
    robots = own.withColumn("ord", nth).where(F.col("ord") <= MAX_SITEMAP_FETCHES).select("site", F.lit(1).alias("round"), "sitemap_url", "ord")
    guess = lambda urls, number, offset: origins.select("site", F.lit(number).alias("round"), F.posexplode(urls).alias("ord", "sitemap_url")).select("site", "round", "sitemap_url", (F.col("ord") + offset).alias("ord"))
    hub = first_readable(guess(hub_sitemaps(F.col("origin"), F.col("hub_url")), 1, MAX_SITEMAP_FETCHES + 1), documents)
    usual = first_readable(guess(F.array(*[F.concat("origin", F.lit(p)) for p in CONVENTIONAL_SITEMAPS]), 2, 1), documents)
    return robots.unionByName(hub).unionByName(usual)


def homepage_code(status: Column, error: Column) -> Column:
    """Why a site's homepage ends its discovery; null if it doesn't."""
    return (
        F.when(error.isNotNull() & (error != "timeout"), error)
        .when(error.isNotNull() | status.isNull(), "site_unreachable")
        .when(status.isin(403, 429), "blocked_by_site")
        .when(status >= 400, "site_unreachable")
    )


def discover_sites(homepages: DataFrame, robots: DataFrame, documents: DataFrame, agent: str, limit: int = POST_LIMIT) -> DataFrame:
    """(page_id, entered_url, origin, hub_url, round, members, post, url, allowed, crawl_delay, error_code).

    A row for each post of a site, or one row with an error_code for a site without: blocked_by_site, site_unreachable or
    the code of its fetch, no_sitemap, no_blog_found. homepages(page_id, entered_url, url, status, error, html): the answers
    to the entered URLs, one a site; robots(origin, status, content_type, robots); documents(sitemap_url, kind, ord, loc),
    a readable sitemap without locations as a row of nulls. A hub on a subdomain moves the origin there.
    """
    home = cut(homepages.withColumn("error_code", homepage_code(F.col("status"), F.col("error"))))
    live = home.where("error_code is null")
    hubs = find_hub(anchors(live), live.select("page_id", "entered_url"))
    origin = lambda c: strip_default_port(F.lower(F.regexp_extract(c, r"(?i)^https?://[^/?#]+", 0)))
    moved = F.col("hub_url").isNotNull() & (site_key(host(F.col("hub_url"))) != site_key(host(F.col("url"))))
    found = live.join(hubs, "page_id").select("page_id", origin(F.when(moved, F.col("hub_url")).otherwise(F.col("url"))).alias("origin"), "hub_url")
    found = cut(found.withColumn("site", site_key(host(F.col("origin")))))
    rules = cut(found.select("site", "origin").join(robots, "origin", "left"))
    documents = cut(documents.withColumn("site", F.lit(None).cast("string")))
    rounds = cut(sitemap_rounds(found, robots_sitemaps(rules), documents))
    posts = discover_blog(rounds, documents, found.select("site", "hub_url"), limit)
    asked = posts.join(rules.drop("origin"), "site")
    verdicts = robots_check(asked.select("url", "status", "content_type", "robots"), agent)
    posts = cut(posts.join(verdicts.dropDuplicates(["url"]), "url"))
    any_map = expand_indexes(rounds.select("site", "sitemap_url", "ord"), documents).select("site").distinct().withColumn("mapped", F.lit(True))
    done = found.join(posts, "site", "left").join(any_map, "site", "left")
    code = F.when(F.col("url").isNotNull(), F.lit(None).cast("string")).when(F.col("mapped"), "no_blog_found").otherwise("no_sitemap")
    done = done.select("page_id", "origin", "hub_url", "round", "members", "post", "url", "allowed", "crawl_delay", code.alias("late"))
    return home.select("page_id", "entered_url", "error_code").join(done, "page_id", "left").withColumn("error_code", F.coalesce("error_code", "late")).select("page_id", "entered_url", "origin", "hub_url", "round", "members", "post", "url", "allowed", "crawl_delay", "error_code")


def _parts_read(urls: DataFrame, limit: int) -> DataFrame:
    """(site, part): the members that are read until there are URLs enough: under a known hub, else three for each post."""
    p, hub = path(F.col("loc")), F.coalesce(F.col("hub_path") != "/", F.lit(False))
    under = F.coalesce(hub & is_under(p, F.col("hub_path")) & (p != F.col("hub_path")), F.lit(False))
    n = urls.groupBy("site", "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(under).alias("u"))
    before = Window.partitionBy("site").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumns({"n": F.coalesce(F.sum("n").over(before), F.lit(0)), "u": F.coalesce(F.sum("u").over(before), F.lit(0))})
    enough = F.when(F.col("u") > 0, F.col("u") >= limit).otherwise(F.col("n") >= 3 * limit)
    upto = Window.partitionBy("site").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("stop", F.max(enough).over(upto)).where((F.col("part") == 0) | ~F.col("stop")).select("site", "part")


def discover_blog(rounds: DataFrame, documents: DataFrame, hubs: DataFrame, limit: int = POST_LIMIT) -> DataFrame:
    """(site, round, members, post, url): the posts of each site from the first round that gives any.

    rounds(site, round, sitemap_url, ord): where to look, in rounds; documents(site, sitemap_url, kind, ord, loc);
    hubs(site, hub_url). Sites without a row have no sitemap or no blog.
    """
    documents, found = cut(documents), None
    for k in (1, 2):
        maps = cut(expand_indexes(rounds.where(F.col("round") == k), documents))
        scored = cut(family_scores(maps, documents, hubs).where("evidence"))
        best = scored.groupBy("site").agg(F.max_by(F.struct("members", "first_url", "hub_path"), F.struct("score", -F.col("place"))).alias("b")).select("site", "b.*")
        parts = best.select("site", F.posexplode(F.slice("members", 1, MAX_PARTS)).alias("part", "sitemap_url"))
        urls = parts.join(documents.where(F.col("kind") != "index").select("sitemap_url", F.col("ord").alias("at"), "loc"), "sitemap_url")
        urls = urls.where(site_key(host(F.col("loc"))) == F.col("site"))
        urls = urls.join(_parts_read(urls.join(best.select("site", "hub_path"), "site"), limit), ["site", "part"], "left_semi")
        urls = urls.select("site", (F.col("part") * SAMPLE_SIZE + F.col("at")).alias("ord"), "loc")
        sites = best.select("site", "hub_path", has_positive(name_tokens(F.col("first_url"))).alias("posts_only"))
        posts = select_posts(cut(urls), sites, limit).join(best.select("site", "members"), "site").withColumn("round", F.lit(k))
        posts = cut(posts)
        found = posts if found is None else found.unionByName(posts)
    first = found.groupBy("site").agg(F.min("round").alias("round"))
    return found.join(first, ["site", "round"]).select("site", "round", "members", "post", "url")

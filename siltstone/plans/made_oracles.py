"""DuckDB SQL for the queries over made rows: it states what the operators have to make of them, from the same keys."""

from __future__ import annotations

from siltstone.plans.oracles import _CANDIDATES, _CLIENTS, _FACTS, _SNAP, _TABLES


def _pick(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_PART = "part_ AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_name AS name, p_type AS kind, replace(p_name, ' ', '-') AS slug, CASE WHEN p_partkey % 2 = 0 THEN 'https' ELSE 'http' END || '://www.shop' || p_partkey % 5 || '.example' AS origin FROM part)"
_COLUMNS = {
    "page_id": "k",
    "url": "origin || '/p/' || slug || '-' || k",
    "site": "'shop' || k % 5 || '.example'",
    "title": _pick("k", ["NULL", "'T' || k", "'The complete guide to every ' || name || ' and how to pick the right one'", "'Shared title of many pages in a shop'", "repeat('😀', 16) || ' ' || name", "name || ' for every home & garden | Shop'", "'Buy the ' || name || ' — best € prices today'"]),
    "meta_description": _pick("k", ["NULL", "'A ' || kind || ' ' || name", "NULL"]),
    "h1s": _pick("k", ["CAST([] AS VARCHAR[])", "['All about ' || name]", "[name, 'Second <one>']", "['Ｔｅａ ' || name]"]),
    "headings": _pick("k", ["['Care of ' || name, 'Sizes']", "CAST([] AS VARCHAR[])"]),
    "canonical": _pick("k", ["NULL", "origin || '/p/' || slug || '-' || k || '#top'", "'/p/' || slug || '-' || k", "'/p/other'", "'mailto:shop@example.com'"]),
    "resolved": _pick("k", ["NULL", "origin || '/p/' || slug || '-' || k", "origin || '/p/' || slug || '-' || k", "origin || '/p/other'", "'mailto:shop@example.com'"]),
    "robots": _pick("k", ["'noindex, follow,'", "'googlebot: noindex,'", "','", "',otherbot: noindex'", "',unavailable_after: 25 jun 2030'", "',none'"]),
    "lang": _pick("k", ["NULL", "'en-GB'", "'en-GB'", "'en-GB'"]),
    "types": _pick("k", ["CAST([] AS VARCHAR[])", "['Product']", "['Article', 'Thing']", "CAST([] AS VARCHAR[])"]),
    "jsonld": _pick("k", ["CAST([] AS VARCHAR[])", "[name, 'tea pots']", "['garden tools', 'x']", "CAST([] AS VARCHAR[])"]),
    "images": "CAST(k % 4 AS INTEGER)",
    "missing": _pick("k", ["CAST([] AS VARCHAR[])", "CAST([] AS VARCHAR[])", "['/b.png']", "['/b.png', '(no src)']"]),
    "insecure": "CAST(CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 3 ELSE 0 END AS INTEGER)",
    "scripts": "CAST(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END AS INTEGER)",
    "main_text": f"rtrim(repeat(name || ' ', {_pick('(k // 3)', ['3', '60', '200'])})) || ' tail end'",
    "words": f"CAST(2 * {_pick('(k // 3)', ['3', '60', '200'])} + 2 AS INTEGER)",
}
_MADE = f"{_PART}, facts AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _COLUMNS.items())} FROM part_)"
_UTF16 = "length({x}) + len(regexp_extract_all({x}, '[\\x{{10000}}-\\x{{10FFFF}}]'))"
_SIZE = _UTF16.format(x="title")

_RULES = [
    ("noindex", "error", "k0 IN (0, 1, 5)", "'Page asks search engines not to index it'", "{'robots': robots}"),
    ("title_missing", "error", "title IS NULL", "'Page has no <title>'", None),
    ("title_length", "warning", f"{_SIZE} NOT BETWEEN 30 AND 60", f"'Title is ' || ({_SIZE}) || ' characters; 30–60 usually displays best'", f"{{'length': {_SIZE}}}"),
    ("title_duplicate", "warning", "title IS NOT NULL AND copies > 1", "copies || ' crawled pages share this title'", "{'title': title}"),
    ("meta_description_missing", "warning", "meta_description IS NULL", "'Page has no meta description'", None),
    ("h1_missing", "error", "len(h1s) = 0", "'Page has no H1 heading'", None),
    ("h1_multiple", "warning", "len(h1s) > 1", "'Page has ' || len(h1s) || ' H1 headings'", "{'h1s': h1s}"),
    ("canonical_missing", "warning", "canonical IS NULL", "'Page has no canonical URL'", None),
    ("canonical_mismatch", "warning", "resolved <> url", "'Canonical URL points to a different page'", "{'canonical': resolved}"),
    ("thin_content", "warning", "words BETWEEN 50 AND 299", "'Only ' || words || ' words of main content'", "{'words': words}"),
    ("client_rendered", "warning", "words < 50 AND scripts > 0", "'Almost no text in the HTML: content is likely rendered by JavaScript, which crawlers may not see'", "{'words': words, 'scripts': scripts}"),
    ("images_missing_alt", "warning", "len(missing) > 0", "len(missing) || ' of ' || images || ' images have no alt text'", "{'images': missing}"),
    ("mixed_content", "warning", "insecure > 0", "insecure || ' resources load over plain http'", "{'count': insecure}"),
]
_FOUND = " UNION ALL ".join(f"SELECT page_id, '{code}' AS code, '{severity}' AS severity, {message} AS message, {f'CAST(to_json({details}) AS VARCHAR)' if details else 'CAST(NULL AS VARCHAR)'} AS details FROM counted WHERE {when}" for code, severity, when, message, details in _RULES)

_EXTRA = "UNION ALL SELECT site, page_id, 'schema', unnest(flatten(list_transform(jsonld, lambda h: {many}))) FROM facts UNION ALL SELECT site, page_id, 'heading', unnest(flatten(list_transform(headings, lambda h: {many}))) FROM facts UNION ALL SELECT site, page_id, 'meta', term FROM (SELECT site, page_id, unnest({running}) AS term FROM facts WHERE meta_description IS NOT NULL) WHERE contains(term, ' ') UNION ALL SELECT site, page_id, 'slug'"


def _made_candidates() -> str:
    from siltstone.plans.oracles import _phrases

    extra = _EXTRA.format(many=_phrases("h", True), running=_phrases("meta_description", False))
    rest = _CANDIDATES[len(_FACTS) :].replace("UNION ALL SELECT site, page_id, 'slug'", extra).replace("unnest(flatten(list_transform(h1s,", "unnest(flatten(list_transform(list_transform(h1s, lambda x: replace(x, 'Ｔｅａ', 'Tea')),")
    return f"WITH {_MADE}{rest} SELECT site, page_id, term, array_to_string(sources, ',') AS sources, body_count FROM cands"


_HOPS = "CAST(least(k % 8, 5) AS BIGINT)"
_LAST = "CASE WHEN k % 8 BETWEEN 1 AND 5 AND k % 11 = 0 THEN 'https://192.168.0.' || k % 250 || '/' WHEN k % 8 BETWEEN 1 AND 5 AND k % 13 = 0 THEN 'ftp://a.example/' ELSE 'https://a.example/' || k || '/' || least(k % 8, 5) END"
_REFUSED = _pick("k", ["NULL", "'invalid_url'", "'invalid_url'", "'blocked_host'", "'blocked_host'", "'blocked_host'", "NULL", "'invalid_url'"])
_TARGETS = _pick("k", ["''", "'ftp://a.example/' || k", "'http://u:p@a.example/' || k", "'http://10.0.0.' || k % 250 || '/' || k", "'https://[::1]/' || k", "'http://a.example:8080/' || k", "''", "''"])
_ASKED = _pick("k", ["2000.0::DOUBLE", "30000.0::DOUBLE", "1500.0::DOUBLE", "NULL", "NULL", "NULL"])
_UNITS = "flatten(list_transform(string_split(x, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [CAST(55296 + ((unicode(c) - 65536) >> 10) AS BIGINT), CAST(56320 + ((unicode(c) - 65536) & 1023) AS BIGINT)] ELSE [CAST(unicode(c) AS BIGINT)] END))"

_SITE = "s AS (SELECT CAST(s_suppkey AS BIGINT) AS k, 's' || s_suppkey || '.example' AS h FROM supplier)"
_POSTS = "a-long-post-"
_DISCOVERED = f"""{_SITE},
hubs AS (SELECT k, h, CASE k % 10 WHEN 5 THEN 'https://' || h || '/insights' WHEN 6 THEN 'https://news.' || h || '/' WHEN 7 THEN 'https://' || h || '/journal/' WHEN 9 THEN 'https://www.' || h || '/stories/' END AS hub FROM s),
posts AS (
SELECT k, 1 AS round, i + 1 AS post, 'https://' || h || '/insights/{_POSTS}' || i AS url, i <> 1 AND i < 10 AS allowed, 3.0::DOUBLE AS delay, 'https://' || h || '/post-sitemap.xml' AS members FROM s, range(15) AS r(i) WHERE k % 10 = 5
UNION ALL SELECT k, 2, i + 1, 'https://news.' || h || '/2024/05/{_POSTS}' || i, true, NULL, 'https://cdn.example/' || k || '/sitemap-1.xml' FROM s, range(6) AS r(i) WHERE k % 10 = 6
UNION ALL SELECT k, 1, i + 1, 'https://' || h || CASE WHEN i < 9 THEN '/journal/{_POSTS}' || i ELSE '/journal/more/{_POSTS}' || (i - 9) END, true, NULL, 'https://' || h || '/journal/post-sitemap.xml https://' || h || '/journal/post-sitemap2.xml' FROM s, range(15) AS r(i) WHERE k % 10 = 7
UNION ALL SELECT k, 2, i + 1, 'https://' || h || '/stories/{_POSTS}' || i, true, NULL, 'https://' || h || '/sitemap-index.xml' FROM s, range(5) AS r(i) WHERE k % 10 = 9)"""

_SESSIONS = "ss AS (SELECT sha256('t' || event_id) AS id, user_id, event_id, ts + INTERVAL 7 DAY AS expires_at, TIMESTAMP '2024-01-20' AS now FROM events), live AS (SELECT *, expires_at <= now + INTERVAL 84 HOUR AS renewed FROM ss WHERE expires_at > now)"
_DETAILS = f"""WITH {_TABLES}, dk AS (SELECT page_id, string_agg(k.id || ':' || term || ':' || score || ':body:' || coalesce(CAST(position AS VARCHAR), '-') || ':' || coalesce(date, '-'), ';' ORDER BY rank_order, pk.id) AS keywords FROM pk JOIN k ON k.id = keyword_id LEFT JOIN lt ON page_keyword_id = pk.id GROUP BY page_id),
di AS (SELECT page_id, string_agg(severity || ':' || code, ';' ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, code) AS issues FROM i GROUP BY page_id),
det AS (SELECT printf('%08x-0000-4000-8000-000000000000', p.id) AS id, url, c.name AS client_name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS fetched_at, coalesce(keywords, '') AS keywords, coalesce(issues, '') AS issues FROM p JOIN c ON c.id = p.client_id JOIN orders ON o_orderkey = p.id LEFT JOIN dk ON dk.page_id = p.id LEFT JOIN di ON di.page_id = p.id WHERE c.user_id = 3)"""



def _reported() -> str:
    """The lines of a report, from what each kind of site has to give."""
    said = {0: "blocked_by_site): The site refused the crawler (for example bot protection or rate limiting).", 1: "site_unreachable): The website did not respond or returned an error.", 2: "site_unreachable): The website did not respond or returned an error.", 3: "no_sitemap): No sitemap was found: none listed in robots.txt works and the usual locations are missing.", 4: "no_blog_found): Sitemaps were found, but none of them lists blog posts.", 8: "too_many_redirects): The website redirects in a loop."}
    codes = " ".join(f"WHEN {k} THEN '{v}'" for k, v in said.items())
    return f"""WITH {_DISCOVERED},
g AS (SELECT k, max(members) AS members, list(printf('%3d  %s', CAST(post AS INTEGER), url) || CASE WHEN allowed THEN '' ELSE '  (forbidden by robots.txt)' END ORDER BY post) AS listed FROM posts GROUP BY k),
r AS (SELECT hubs.k, CASE WHEN listed IS NULL THEN ['site: https://www.' || h, 'nothing found (' || CASE hubs.k % 10 {codes} END] ELSE list_concat(['site: https://' || CASE WHEN hubs.k % 10 = 6 THEN 'news.' ELSE '' END || h, 'hub: ' || coalesce(hub, 'none linked'), 'sitemaps: ' || replace(members, ' ', ', '), 'pause: ' || CASE WHEN hubs.k % 10 = 5 THEN '3.0 s' ELSE 'none' END, 'posts: ' || len(listed)], listed) END AS lines FROM hubs LEFT JOIN g USING (k))
SELECT k AS page_id, generate_subscripts(lines, 1) - 1 AS line, unnest(lines) AS text FROM r"""


def _crawled() -> str:
    """Crawls from the keys: what each page gives, where a site is left after three refusals in a row, and the outcomes."""
    return f"""WITH {_MADE},
e AS (SELECT page_id AS k, site, title, page_id % 13 <> 0 AS allowed, page_id % 23 = 0 AS late, page_id % 5 = 2 AND page_id // 5 % 10 IN (3, 4, 5) OR page_id % 5 = 3 AND page_id // 5 % 4 = 1 AS refused, page_id % 29 <> 0 AND page_id % 31 <> 0 AS html FROM facts),
s AS (SELECT *, CASE WHEN late THEN NULL WHEN refused THEN 403 WHEN k % 17 = 0 THEN 404 WHEN k % 19 = 0 THEN 500 ELSE 200 END AS status FROM e),
o AS (SELECT *, CASE WHEN late THEN 'failed' WHEN status = 403 OR k % 37 = 0 THEN 'blocked' WHEN status >= 400 OR NOT html THEN 'failed' ELSE 'ok' END AS found FROM s),
a AS (SELECT *, found = 'blocked' AND coalesce(lag(found) OVER w = 'blocked' AND lag(found, 2) OVER w = 'blocked', false) AS third FROM o WHERE allowed WINDOW w AS (PARTITION BY site ORDER BY k)),
l AS (SELECT site, min(k) AS third FROM a WHERE third GROUP BY site),
r AS (SELECT o.*, coalesce(k > third, false) AND allowed AS left_out, CASE WHEN NOT allowed THEN 'skipped_robots' WHEN k > third THEN 'blocked' ELSE found END AS fetched FROM o LEFT JOIN l USING (site)),
n AS (SELECT site, count(*) AS total, count(*) FILTER (WHERE fetched = 'ok') AS analysed FROM r GROUP BY site)
SELECT 'page' AS kind, k AS page_id, site, fetched AS value, CASE WHEN fetched = 'ok' THEN title END AS more, CASE WHEN allowed THEN CAST(status AS BIGINT) END AS number FROM r
UNION ALL SELECT 'issue', k, NULL, CASE WHEN left_out THEN 'URL listed in the sitemap could not be fetched: blocked by the site' WHEN late THEN 'URL listed in the sitemap could not be fetched: timeout' WHEN fetched = 'failed' AND status < 400 THEN 'URL listed in the sitemap could not be fetched: Not an HTML page (' || CASE WHEN k % 29 = 0 THEN 'application/pdf' ELSE 'no content type' END || ')' ELSE 'URL listed in the sitemap returns HTTP ' || status END, 'error', NULL FROM r WHERE fetched IN ('failed', 'blocked')
UNION ALL SELECT 'outcome', NULL, site, CASE WHEN total = analysed THEN 'done' ELSE 'partial' END || CASE WHEN third IS NOT NULL THEN ' blocked_by_site' ELSE '' END, CASE WHEN total <> analysed THEN (total - analysed) || ' of ' || total || ' pages could not be analysed' END, analysed FROM n LEFT JOIN l USING (site)"""


MADE_ORACLES = {
    "made_page_facts": f"WITH {_MADE} SELECT page_id, site, title, meta_description, array_to_string(h1s, '|') AS h1s, array_to_string(headings, '|') AS headings, canonical, robots, lang, array_to_string(types, '|') AS jsonld_types, array_to_string(jsonld, '|') AS jsonld_keywords, images AS images_total, array_to_string(missing, '|') AS images_missing_alt, insecure AS insecure_resources, main_text, scripts AS script_count, words AS word_count FROM facts",
    "made_page_issues": f"WITH {_MADE}, counted AS (SELECT *, page_id % 6 AS k0, count(title) OVER (PARTITION BY site, title) AS copies FROM facts) {_FOUND}",
    "made_candidates": _made_candidates(),
    "url_forms": f"SELECT k AS p_partkey, {_pick('k', ['n', 'n2', 'n3', 'NULL', chr(39) + 'https://base.example/a/b?page=' + chr(39) + ' || k', chr(39) + 'https://a.example/x' + chr(39), 'NULL', chr(39) + 'https://a.example:8443/?reference=1' + chr(39)])} AS url, {_pick('k', ['NULL', 'NULL', 'n3', 'NULL', 'NULL', chr(39) + 'https://a.example/x' + chr(39), 'NULL', chr(39) + 'https://a.example:8443/?reference=1' + chr(39)])} AS absolute FROM (SELECT CAST(p_partkey AS BIGINT) AS k, 'https://base.example/x/' || replace(p_name, ' ', '-') || '?b=1' AS n, 'https://www.shop.example/A%20b' AS n2, 'http://xn--bcher-kva.example/%C3%A9%20' || replace(p_name, ' ', '-') AS n3 FROM part)",
    "website_forms": "SELECT c_custkey, CASE WHEN o IS NOT NULL THEN o || p END AS url, o AS origin, regexp_replace(regexp_replace(o, '^https?://(www\\.)?', ''), '\\.$', '') AS site_key FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'https://www.shop' || c_custkey || '.example' WHEN 2 THEN 'http://xn--bcher-kva.example' WHEN 4 THEN 'https://shop' || c_custkey || '.example.' WHEN 6 THEN 'http://[2606:4700::' || (c_custkey + 1) || ']' END AS o, CASE c_custkey % 7 WHEN 0 THEN '/blog' WHEN 2 THEN '/' || c_custkey WHEN 6 THEN '/x' ELSE '/' END AS p FROM customer)",
    "url_containment": "SELECT k AS p_partkey, k % 5 IN (2, 4) AS below, k % 7 IN (0, 1, 2) AS inside, k % 7 IN (4, 5) AS locale FROM (SELECT CAST(p_partkey AS BIGINT) AS k FROM part)",
    "ip_addresses": "SELECT k AS o_orderkey, k % 10 IN (3, 5) OR (k % 10 = 9 AND k % 20 > 15) AS public FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders)",
    "url_targets": f"SELECT k AS c_custkey, {_REFUSED} AS error, CASE WHEN k % 8 IN (1, 2, 7) THEN 'invalid_url' END AS error_inside FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer)",
    "fetch_refusals": f"SELECT {_TARGETS} AS url, CAST(NULL AS INTEGER) AS status, {_REFUSED} AS error FROM (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier) WHERE k % 8 BETWEEN 1 AND 5",
    "redirect_chains": f"SELECT 'https://a.example/' || k || '/0' AS url, {_LAST} AS final_url, {_HOPS} AS hops, CASE WHEN k % 8 > 5 THEN 'too_many_redirects' WHEN k % 8 > 0 AND k % 11 = 0 THEN 'blocked_host' WHEN k % 8 > 0 AND k % 13 = 0 THEN 'invalid_url' END AS error FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders)",
    "retry_policy": f"SELECT k AS o_orderkey, (k % 5 BETWEEN 1 AND 3 OR k % 7 IN (2, 3)) AND k % 4 + 1 < 3 AS again, round(coalesce({_ASKED}, 500 * pow(2, k % 4) * (0.5::DOUBLE + (k % 100) / 100)), 6) AS pause_ms FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders)",
    "decoded_bodies": f"SELECT k AS p_partkey, {_pick('k', ['n || chr(32) || chr(233) || chr(8364)', 'n || chr(32) || chr(233)', chr(39) + '<meta charset=latin1>' + chr(39) + ' || n || chr(32) || chr(233)', 'n || chr(32) || chr(233) || chr(8364)', 'n', 'n || chr(32) || chr(233)'])} AS body FROM (SELECT CAST(p_partkey AS BIGINT) AS k, p_name AS n FROM part)",
    "text_hashes": f"SELECT p_partkey, list_reduce({_UNITS}, lambda h, u: (xor(h, u) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) AS fnv, sha256(x) AS token_id, CAST({_UTF16.format(x='x')} AS BIGINT) AS units FROM (SELECT p_partkey, p_name || '|é😀' || p_partkey AS x FROM part)",
    "discover_site": f"""WITH {_DISCOVERED} SELECT s.k AS page_id, CASE WHEN s.k % 10 IN (0, 1, 2, 8) THEN NULL WHEN s.k % 10 = 6 THEN 'https://news.' || s.h ELSE 'https://' || s.h END AS origin, hub AS hub_url, CAST(round AS BIGINT) AS round, members, CAST(post AS BIGINT) AS post, url, allowed, delay AS crawl_delay, CASE s.k % 10 WHEN 0 THEN 'blocked_by_site' WHEN 1 THEN 'site_unreachable' WHEN 2 THEN 'site_unreachable' WHEN 3 THEN 'no_sitemap' WHEN 4 THEN 'no_blog_found' WHEN 8 THEN 'too_many_redirects' END AS error_code FROM s JOIN hubs USING (k) LEFT JOIN posts USING (k)""",
    "discovery_report": _reported(),
    "whole_crawls": f"""WITH {_DISCOVERED}, n AS (SELECT k, count(*) AS total, count(*) FILTER (WHERE allowed AND post % 7 <> 3 AND post % 5 <> 0 AND post <> 9) AS analysed FROM posts GROUP BY k),
c AS (SELECT s.k, CASE s.k % 10 WHEN 0 THEN 'blocked_by_site' WHEN 1 THEN 'site_unreachable' WHEN 2 THEN 'site_unreachable' WHEN 3 THEN 'no_sitemap' WHEN 4 THEN 'no_blog_found' WHEN 8 THEN 'too_many_redirects' END AS code FROM s)
SELECT k AS page_id, CASE WHEN code IS NOT NULL THEN 'failed' WHEN total = analysed THEN 'done' ELSE 'partial' END AS crawl_status, code AS error_code, CASE WHEN code IS NULL THEN CASE WHEN total <> analysed THEN (total - analysed) || ' of ' || total || ' pages could not be analysed' END ELSE CASE code WHEN 'blocked_by_site' THEN 'The site refused the crawler (for example bot protection or rate limiting).' WHEN 'site_unreachable' THEN 'The website did not respond or returned an error.' WHEN 'no_sitemap' THEN 'No sitemap was found: none listed in robots.txt works and the usual locations are missing.' WHEN 'no_blog_found' THEN 'Sitemaps were found, but none of them lists blog posts.' ELSE 'The website redirects in a loop.' END END AS message, coalesce(total, 0) AS pages_total, coalesce(analysed, 0) AS pages_done FROM c LEFT JOIN n USING (k)""",
    "site_hubs": f"WITH {_DISCOVERED} SELECT k AS page_id, hub AS hub_url FROM hubs WHERE k % 10 NOT IN (0, 1, 2, 8)",
    "inferred_posts": "SELECT site, row_number() OVER (PARTITION BY site ORDER BY k) AS post, url FROM (SELECT CAST(p_partkey AS BIGINT) AS k, 'shop' || p_partkey % 5 || '.example' AS site, 'https://shop' || p_partkey % 5 || '.example/' || CASE p_partkey % 5 WHEN 0 THEN 'news' ELSE 'p' END || '/' || replace(p_name, ' ', '-') || '-' || p_partkey AS url FROM part WHERE p_partkey % 5 < 2) QUALIFY post <= 15",
    "local_today": "SELECT c_custkey, CAST(timezone('America/Toronto', t) AS DATE) AS toronto, CAST(timezone('Asia/Tokyo', t) AS DATE) AS tokyo, CAST(timezone('UTC', t) AS DATE) AS utc FROM (SELECT c_custkey, to_timestamp(1704067200 + c_custkey * 3700) AS t FROM customer)",
    "history_spans": "SELECT c_custkey, CASE WHEN n > 0 THEN greatest(365, CAST(ceil(50000 / nullif(n, 0)) AS BIGINT)) ELSE 365 END AS days, CASE WHEN c_custkey % 3 = 0 THEN 1000.0::DOUBLE ELSE least(5000.0::DOUBLE, (c_custkey % 10) / 2 * 1000) END AS pause_ms, greatest(1, CAST(ceil(n / 20) AS BIGINT)) AS last_page FROM (SELECT c_custkey, c_custkey % 400 AS n FROM customer)",
    "paging_checks": f"WITH r AS (SELECT o_orderkey, {_pick('o_orderkey', ['1', '0', '3', 'NULL', '-2', '1', '7'])} AS page, {_pick('o_orderkey', ['20', '0', '100', '101', 'NULL'])} AS size, {_pick('o_orderkey', ['NULL', chr(39) + 'tea' + chr(39), chr(39) + chr(39), 'repeat(o_orderpriority, 20)', 'repeat(' + chr(39) + 'x' + chr(39) + ', 200)', 'repeat(' + chr(39) + 'é' + chr(39) + ', 201)'])} AS q FROM orders), e AS (SELECT *, CASE WHEN coalesce(page, 1) < 1 OR coalesce(size, 20) < 1 OR size > 100 THEN 'page starts at 1, page_size is 1 to 100' WHEN length(trim(q)) > 200 THEN 'a search has at most 200 characters' END AS error FROM r) SELECT o_orderkey, CASE WHEN error IS NULL THEN nullif(trim(q), '') END AS q, error, CAST(CASE WHEN error IS NULL THEN 200 ELSE 400 END AS BIGINT) AS status FROM e",
    "uuid_ids": "SELECT c_custkey, c_custkey % 6 IN (0, 1) AS valid FROM customer",
    "health": " UNION ALL ".join(f"SELECT '{t}' AS relation, true AS ok, count(*) AS rows FROM {t}" for t in ("nation", "customer", "orders", "lineitem", "part", "events", "documents", "pages")) + " UNION ALL SELECT 'nowhere', false, NULL",
    "empty_relations": f"WITH {_TABLES} SELECT * FROM (VALUES ('users', 5), ('sessions', 4), ('clients', 16), ('pages', 15), ('keywords', 2), ('page_keywords', 6), ('seo_issues', 5), ('rank_snapshots', 4)) AS t(name, n_columns) JOIN (SELECT 'users' AS name, count(*) AS n_rows FROM nation UNION ALL SELECT 'sessions', 0 UNION ALL SELECT 'clients', count(*) FROM c UNION ALL SELECT 'pages', count(*) FROM p UNION ALL SELECT 'keywords', count(*) FROM k UNION ALL SELECT 'page_keywords', count(*) FROM pk UNION ALL SELECT 'seo_issues', count(*) FROM i UNION ALL SELECT 'rank_snapshots', count(*) FROM rs) USING (name)".replace("SELECT * FROM (VALUES", "SELECT name, CAST(n_columns AS BIGINT) AS n_columns, n_rows FROM (VALUES"),
    "bulk_rows": "SELECT user_id, event_id, event_type, value FROM events",
    "user_upserts": "SELECT CASE WHEN k % 3 = 0 THEN 'new' || k ELSE CAST(k AS VARCHAR) END AS id, 'user' || k || '@shop.example' AS email, CASE WHEN k % 3 = 1 THEN 'old' ELSE 'fresh' END AS password_hash, CASE WHEN k % 3 = 0 THEN 'America/Toronto' ELSE 'Asia/Tokyo' END AS timezone FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer)",
    "client_inserts": f"SELECT user_id, 'Shop ' || k AS name, {_pick('k', [chr(39) + 'https://www.shop' + chr(39) + ' || k || ' + chr(39) + '.example/' + chr(39), chr(39) + 'http://shop' + chr(39) + ' || k || ' + chr(39) + '.example/' + chr(39), 'NULL', chr(39) + 'https://shop' + chr(39) + ' || k || ' + chr(39) + '.example./x' + chr(39), chr(39) + 'https://shop' + chr(39) + ' || k || ' + chr(39) + '.example/' + chr(39)])} AS website_url, 'shop' || k || '.example' AS site_key FROM (SELECT CAST(c_custkey AS BIGINT) AS k, c_nationkey AS user_id FROM customer) WHERE k % 5 <> 2 AND k % 4 <> 0",
    "live_sessions": f"WITH {_SESSIONS} SELECT id, 'u' || user_id || '@shop.example' AS email, strftime(CASE WHEN renewed THEN now + INTERVAL 7 DAY ELSE expires_at END, '%Y-%m-%dT%H:%M:%SZ') AS expires_at, renewed FROM live",
    "token_session": f"WITH {_SESSIONS} SELECT 'u' || user_id || '@shop.example' AS email, renewed FROM live WHERE event_id = (SELECT max(event_id) FROM events)",
    "session_purge": f"WITH {_SESSIONS} SELECT count(*) AS deleted FROM ss WHERE expires_at <= now",
    "save_analysis": """WITH old AS (SELECT min(p_partkey) AS id, p_name AS term FROM part WHERE p_partkey % 3 = 0 GROUP BY p_name),
li AS (SELECT l_orderkey AS page_id, p_name, l_linenumber, l_quantity, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey),
done AS (SELECT o_orderkey AS page_id, o_orderstatus <> 'F' AS fetched FROM orders WHERE o_orderkey % 4 <> 0),
picks AS (SELECT page_id, p_name || CASE WHEN page_id % 5 = 0 THEN ' set' ELSE '' END AS term, max(l_quantity) AS score FROM li WHERE l_linenumber > 1 AND page_id IN (SELECT page_id FROM done WHERE fetched) GROUP BY ALL),
fresh AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY term) AS id, term FROM (SELECT DISTINCT term FROM picks WHERE term NOT IN (SELECT term FROM old))),
terms AS (SELECT * FROM old UNION ALL SELECT * FROM fresh),
pairs AS (SELECT page_id, old.id AS keyword_id, max(l_quantity) AS score, page_id * 100000 + old.id AS id, term FROM li JOIN old ON p_name = term WHERE l_linenumber <= 2 GROUP BY page_id, old.id, term)
SELECT 'term' AS kind, NULL AS page_id, id, term AS name, NULL AS score FROM terms
UNION ALL SELECT 'pair', page_id, id, term, score FROM pairs WHERE page_id NOT IN (SELECT page_id FROM done WHERE fetched)
UNION ALL SELECT 'pair', p.page_id, o.id, p.term, p.score FROM picks p LEFT JOIN pairs o ON o.page_id = p.page_id AND o.term = p.term
UNION ALL SELECT 'issue', page_id, NULL, CASE WHEN fetched THEN 'thin_content' ELSE 'http_error' END, NULL FROM done
UNION ALL SELECT DISTINCT 'issue', page_id, NULL, 'noindex', NULL FROM li WHERE l_returnflag = 'R' AND page_id NOT IN (SELECT page_id FROM done)""",
    "crawl_resume": f"WITH {_CLIENTS} SELECT id, row_number() OVER (ORDER BY id) AS place FROM cl WHERE status = 'pending' OR (status IN ('discovering', 'crawling') AND (beat IS NULL OR beat < 500000))",
    "page_details": f"{_DETAILS} SELECT * FROM det",
    "page_detail": f"{_DETAILS} SELECT * FROM det ORDER BY id LIMIT 1",
    "page_detail_refused": f"{_DETAILS} SELECT * FROM det WHERE false",
    "chart_series": f"WITH {_TABLES} SELECT page_id, id FROM pk QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank_order, id) <= 3",
    "seeded_accounts": "WITH u AS (SELECT CAST(c_custkey AS BIGINT) AS k, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'n' END || c_custkey AS id FROM customer) SELECT id, 'user' || k || '@shop.example' AS email, 'fresh' AS password_hash, NULL AS site_key FROM u UNION ALL SELECT id, NULL, NULL, 'shop' || k || '.example' FROM u WHERE k % 6 <> 0",
    "seeded_ranks": f"WITH {_TABLES}, own AS (SELECT pk.id FROM pk JOIN p ON p.id = page_id JOIN c ON c.id = p.client_id WHERE c.user_id = 3), n AS (SELECT greatest(365, CAST(ceil(50000 / count(*)) AS BIGINT)) AS days FROM own), held AS (SELECT page_keyword_id, count(DISTINCT CAST(captured_at AS DATE)) AS k FROM rs, n WHERE CAST(captured_at AS DATE) BETWEEN DATE '1998-12-31' - CAST(days - 1 AS INTEGER) AND DATE '1998-12-31' GROUP BY 1) SELECT own.id AS page_keyword_id, days - coalesce(k, 0) AS days FROM own CROSS JOIN n LEFT JOIN held ON held.page_keyword_id = own.id WHERE days > coalesce(k, 0)",
    "analysed_crawl": _crawled(),
    "stream_counts": f"WITH {_SNAP} SELECT strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS start, count(*) AS n, count(*) - count(position) AS unranked FROM snaps GROUP BY 1",
    "chart_ranges": "WITH t AS (SELECT user_id, CAST(max(ts) AS DATE) AS last FROM events GROUP BY user_id) SELECT t.user_id, CAST(n AS BIGINT) AS days, CAST(last - (n - 1) AS DATE) AS first, last, count(*) AS captures FROM t CROSS JOIN (VALUES (7), (30), (90), (365)) AS r(n) JOIN events e ON e.user_id = t.user_id AND CAST(ts AS DATE) BETWEEN last - (n - 1) AND last GROUP BY ALL",
}

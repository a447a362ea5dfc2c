"""DuckDB SQL for the registered queries, written apart from the Spark code."""

from __future__ import annotations

from siltstone.functions.constants import ARCHIVE_SEGMENTS, BLOCK_TAGS, BLOCKED_IPV4, NOISE_TAGS, SOURCE_WEIGHTS, STOPWORDS


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"), ("&amp", "&")]


def _decode(x: str) -> str:
    for name, value in _ENTITIES:
        x = f"replace({x}, '{name}', '{value}')"
    return x


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


_TITLE = f"nullif({_collapse(_decode(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, '')"
_H1S = f"list_filter(list_transform(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda h: {_collapse(_decode("regexp_replace(h, '(?s)<[^>]*>', '', 'g')"))}), lambda h: h <> '')"
_LANG = r"""nullif(trim(regexp_extract(html, '(?is)<html[^>]*\slang\s*=\s*["'']([^"'']*)["'']', 1)), '')"""
_NOISE, _BLOCK = "|".join(NOISE_TAGS), "|".join(BLOCK_TAGS)
_MAIN = r"regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)"
_MAIN = rf"regexp_replace({_MAIN}, '(?is)<({_NOISE})\b.*?</({_NOISE})>', '', 'g')"
_MAIN = rf"regexp_replace(regexp_replace({_MAIN}, '(?is)<!--.*?-->', '', 'g'), '(?i)</?({_BLOCK})\b[^>]*>', ' ', 'g')"
_MAIN = _collapse(_decode(f"regexp_replace({_MAIN}, '(?s)<[^>]*>', '', 'g')"))
_WORDS = r"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+(?:[''’-][\p{{L}}\p{{N}}]+)*'))"
_SITE = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '^www\.', ''), '\.$', '')"
_PATH = r"lower(CASE WHEN regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1) END)"
_CUT = "split_part(url, '#', 1)"
_QUERY = rf"array_to_string(list_filter(string_split(CASE WHEN contains({_CUT}, '?') THEN substr({_CUT}, instr({_CUT}, '?') + 1) ELSE '' END, '&'), lambda p: NOT regexp_matches(p, '(?i)^(utm_[a-z]+|gclid|fbclid|mc_cid|mc_eid|ref)(=|$)')), '&')"
_BASE = rf"lower(regexp_extract({_CUT}, '^[^:]+://[^/?]+')) || CASE WHEN regexp_extract(split_part({_CUT}, '?', 1), '^[^:]+://[^/]+(.*)$', 1) = '' THEN '/' ELSE regexp_extract(split_part({_CUT}, '?', 1), '^[^:]+://[^/]+(.*)$', 1) END"
_NORMAL = f"({_BASE} || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END)"
_NORMAL = rf"array_to_string(list_transform(string_split({_NORMAL}, ''), lambda c: CASE WHEN regexp_matches(c, '[\x21-\x7E]') THEN c WHEN c = ' ' THEN '%20' ELSE url_encode(c) END), '')"


def _phrases(x: str, inner: bool) -> str:
    """All phrases of a text, as a list."""
    words = rf"list_transform(string_split_regex(replace(replace(lower({x}), '’', ''''), '‘', ''''), '[.,;:!?()\[\]{{}}\x22“”|/\\–—]+|\s-\s'), lambda s: regexp_extract_all(s, '[\p{{L}}\p{{N}}]+(?:''[\p{{L}}]+)?'))".replace("{{", "{").replace("}}", "}")
    stops = _list(STOPWORDS)
    good = f"NOT list_contains({stops}, w[i]) AND NOT list_contains({stops}, w[i + n - 1]) AND NOT regexp_full_match(w[i], '[0-9]+') AND NOT regexp_full_match(w[i + n - 1], '[0-9]+') AND NOT suffix(w[i + n - 1], '''s') AND (n > 1 OR length(w[i]) >= 3)"
    if not inner:
        good += f" AND NOT list_has_any(w[i:i + n - 1], {stops})"
    return f"flatten(list_transform({words}, lambda w: flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(list_filter(range(1, least(4, len(w) - i + 1) + 1), lambda n: {good}), lambda n: array_to_string(w[i:i + n - 1], ' '))))))"


_FACTS = f"facts AS (SELECT page_id, url, {_SITE} AS site, {_TITLE} AS title, {_H1S} AS h1s, {_MAIN} AS main_text, len(regexp_extract_all(html, '(?i)<script[^>]*\\ssrc\\s*=')) AS scripts FROM pages), worded AS (SELECT *, {_WORDS.format(x='main_text')} AS words, count(title) OVER (PARTITION BY site, title) AS title_count FROM facts)"
_ISSUES = f"""{_FACTS}, found AS (
SELECT page_id, 'title_missing' AS code, 'error' AS severity, 'Page has no <title>' AS message FROM worded WHERE title IS NULL
UNION ALL SELECT page_id, 'title_length', 'warning', 'Title is ' || length(title) || ' characters; 30–60 usually displays best' FROM worded WHERE title IS NOT NULL AND length(title) NOT BETWEEN 30 AND 60
UNION ALL SELECT page_id, 'title_duplicate', 'warning', title_count || ' crawled pages share this title' FROM worded WHERE title IS NOT NULL AND title_count > 1
UNION ALL SELECT page_id, 'meta_description_missing', 'warning', 'Page has no meta description' FROM worded
UNION ALL SELECT page_id, 'h1_missing', 'error', 'Page has no H1 heading' FROM worded WHERE len(h1s) = 0
UNION ALL SELECT page_id, 'h1_multiple', 'warning', 'Page has ' || len(h1s) || ' H1 headings' FROM worded WHERE len(h1s) > 1
UNION ALL SELECT page_id, 'canonical_missing', 'warning', 'Page has no canonical URL' FROM worded
UNION ALL SELECT page_id, 'thin_content', 'warning', 'Only ' || words || ' words of main content' FROM worded WHERE words BETWEEN 50 AND 299
UNION ALL SELECT page_id, 'client_rendered', 'warning', 'Almost no text in the HTML: content is likely rendered by JavaScript, which crawlers may not see' FROM worded WHERE words < 50 AND scripts > 0)"""

_SLUG = rf"regexp_replace(regexp_replace(url_decode(replace(coalesce(list_filter(string_split(regexp_extract({_CUT}, '(?i)^https?://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '')[-1], ''), '+', '%2B')), '(?i)\.[a-z]+$', ''), '[-_]+', ' ', 'g')"
_STRIPPED = r"CASE WHEN len(string_split_regex(title, '\s+[|•·–—-]\s+')) > 1 THEN array_to_string(string_split_regex(title, '\s+[|•·–—-]\s+')[:-2], ' ') ELSE title END"
_INTRO = "array_to_string(string_split(main_text, ' ')[1:50], ' ')"
_CANDIDATES = f"""{_FACTS}, placed AS (
SELECT site, page_id, 'title' AS source, unnest({_phrases(f"coalesce({_STRIPPED}, '')", True)}) AS term FROM facts
UNION ALL SELECT site, page_id, 'h1', unnest(flatten(list_transform(h1s, lambda h: {_phrases('h', True)}))) FROM facts
UNION ALL SELECT site, page_id, 'slug', unnest({_phrases(_SLUG, True)}) FROM facts
UNION ALL SELECT site, page_id, 'intro', term FROM (SELECT site, page_id, unnest({_phrases(_INTRO, False)}) AS term FROM facts) WHERE contains(term, ' ')
UNION ALL SELECT site, page_id, 'body', unnest({_phrases('main_text', False)}) FROM facts),
suffixes AS (SELECT site, lower(trim(string_split_regex(title, '\\s+[|•·–—-]\\s+')[-1])) AS suffix, count(*) AS n, min(page_id) AS first FROM facts WHERE len(string_split_regex(title, '\\s+[|•·–—-]\\s+')) > 1 GROUP BY ALL),
tops AS (SELECT * FROM suffixes WHERE suffix <> '' QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, first) = 1),
brands AS (SELECT DISTINCT site, word FROM (SELECT t.site, unnest({_phrases('suffix', True)}) AS word FROM tops t JOIN (SELECT site, count(*) AS pages FROM facts GROUP BY site) p ON t.site = p.site WHERE n >= 2 AND n >= pages / 2) WHERE NOT contains(word, ' ')),
brand AS (SELECT site, list(word) AS words FROM brands GROUP BY site),
grouped AS (SELECT site, page_id, term, list_distinct(list(source) FILTER (WHERE source <> 'body')) AS found, count(*) FILTER (WHERE source = 'body') AS body_count FROM placed GROUP BY site, page_id, term),
cands AS (SELECT g.site, page_id, term, list_filter({_list(SOURCE_WEIGHTS)}, lambda s: list_contains(coalesce(found, []), s)) AS sources, body_count FROM grouped g LEFT JOIN brand b ON g.site = b.site WHERE (len(coalesce(found, [])) > 0 OR contains(term, ' ')) AND (b.words IS NULL OR NOT list_has_any(string_split(term, ' '), b.words)))"""
_WEIGHT = "CASE s " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SOURCE_WEIGHTS.items()) + " END"
_SCORES = f"""{_CANDIDATES}, weighed AS (SELECT *, CAST(coalesce(list_sum(list_transform(sources, lambda s: CAST({_WEIGHT} AS DOUBLE))), 0) AS DOUBLE) AS place, count(*) OVER (PARTITION BY site, term) AS df FROM cands),
scores AS (SELECT w.site, page_id, term, (place + ln(1 + body_count) * CASE WHEN place = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) * CASE len(string_split(term, ' ')) WHEN 2 THEN 1.3::DOUBLE WHEN 3 THEN 1.3::DOUBLE WHEN 4 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * (ln((pages + 1) / (df + 1)) + 1) AS score, CASE WHEN body_count > 0 THEN list_append(sources, 'body') ELSE sources END AS sources FROM weighed w JOIN (SELECT site, count(*) AS pages FROM facts GROUP BY site) n ON w.site = n.site WHERE place > 0 OR body_count >= 3)"""

_SNAP = "snaps AS (SELECT user_id, event_type, event_id, ts, CASE WHEN value >= 147.35 THEN NULL ELSE least(100, 1 + CAST(floor(value * 2 / 3) AS INTEGER)) END AS position FROM events)"
_LOCAL = "strftime(timezone('America/Toronto', timezone('UTC', ts)), '%Y-%m-%d')"
_LATEST = f"{_SNAP}, latest AS (SELECT user_id, event_type, position, {_LOCAL} AS date FROM snaps QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, position) = 1)"


def _range(first: str, last: str) -> str:
    return f"timezone('UTC', ts) >= timezone('America/Toronto', TIMESTAMP '{first}') AND timezone('UTC', ts) < timezone('America/Toronto', TIMESTAMP '{last}')"


_TABLES = """c AS (SELECT c_custkey AS id, c_nationkey AS user_id, c_name AS name FROM customer),
p AS (SELECT o_orderkey AS id, o_custkey AS client_id, 'https://shop.example/' || lower(o_orderpriority) || '/' || o_orderkey AS url, o_orderpriority AS title, o_orderstatus AS fetch_status, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS pos FROM orders),
k AS (SELECT min(p_partkey) AS id, p_name AS term FROM part GROUP BY p_name),
named AS (SELECT l.*, k.id AS keyword_id FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN k ON k.term = p_name),
pk AS (SELECT l_orderkey * 1000000 + keyword_id AS id, l_orderkey AS page_id, keyword_id, min(l_linenumber) AS rank_order, max(l_quantity) AS score FROM named GROUP BY l_orderkey, keyword_id),
i AS (SELECT l_orderkey AS page_id, l_returnflag || l_linenumber AS code, CASE WHEN max(l_returnflag) = 'R' THEN 'error' ELSE 'warning' END AS severity FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
rs AS (SELECT l_orderkey * 1000000 + keyword_id AS page_keyword_id, max(l_shipdate) AS captured_at, min(CASE WHEN l_quantity < 45 THEN CAST(l_quantity AS INTEGER) END) AS position FROM named GROUP BY ALL, CAST(l_shipdate AS DATE)),
lt AS (SELECT page_keyword_id, position, strftime(timezone('America/Toronto', timezone('UTC', captured_at)), '%Y-%m-%d') AS date FROM rs QUALIFY row_number() OVER (PARTITION BY page_keyword_id ORDER BY captured_at DESC) = 1),
kw AS (SELECT page_id, string_agg(k.id || ':' || term || ':' || coalesce(CAST(position AS VARCHAR), '-') || ':' || coalesce(date, '-'), ';' ORDER BY rank_order, pk.id) AS keywords, min(position) AS best FROM pk JOIN k ON k.id = keyword_id LEFT JOIN lt ON page_keyword_id = pk.id GROUP BY page_id)"""
_TABLES = _TABLES.replace("GROUP BY ALL, CAST(l_shipdate AS DATE)", "GROUP BY l_orderkey * 1000000 + keyword_id, CAST(l_shipdate AS DATE)")


def _pages(where: str = "true", limit: int = 20, offset: int = 0) -> str:
    return f"""WITH {_TABLES} SELECT p.id, p.url, p.title, p.fetch_status, c.id AS client_id, c.name AS client_name, (SELECT count(*) FROM i WHERE i.page_id = p.id) AS issue_count, (SELECT count(*) FROM i WHERE i.page_id = p.id AND severity = 'error') AS error_count, coalesce(kw.keywords, '') AS keywords, CAST(kw.best AS BIGINT) AS best_position
FROM p JOIN c ON c.id = p.client_id LEFT JOIN kw ON kw.page_id = p.id WHERE c.user_id = 3 AND ({where}) ORDER BY c.name, c.id, p.pos, p.id LIMIT {limit} OFFSET {offset}"""


#: The read relations with per cent signs and underscores in some URLs and terms.
_SIGNS = _TABLES.replace("AS url, o_orderpriority", "|| CASE WHEN o_orderkey % 11 = 0 THEN '?off=5%25' WHEN o_orderkey % 7 = 0 THEN '_A' ELSE '' END AS url, o_orderpriority").replace("k AS (SELECT min(p_partkey) AS id, p_name AS term FROM part GROUP BY p_name)", "k0 AS (SELECT min(p_partkey) AS id, p_name AS term FROM part GROUP BY p_name), k AS (SELECT id, term || CASE WHEN id % 9 = 0 THEN ' 100% Cotton' ELSE '' END AS term, term AS plain FROM k0)").replace("JOIN k ON k.term = p_name", "JOIN k ON k.plain = p_name")


def _search(q: str) -> str:
    return f"contains(lower(p.url), '{q}') OR EXISTS (SELECT 1 FROM pk JOIN k ON k.id = pk.keyword_id WHERE pk.page_id = p.id AND contains(lower(k.term), '{q}'))"


def _ip(text: str) -> int:
    a, b, c, d = map(int, text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


_IP_N = "((o_orderkey * 2654435761) % 4294967296)"
_BLOCKED = " OR ".join(f"n BETWEEN {_ip(a)} AND {_ip(a) + 2 ** (32 - b) - 1}" for a, b in BLOCKED_IPV4)
_CLIENTS = "cl AS (SELECT c_custkey AS id, c_nationkey AS user_id, ['pending', 'discovering', 'crawling', 'done', 'partial', 'failed'][c_custkey % 6 + 1] AS status, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 1000 END AS beat FROM customer)"
_POSTS = f"""u AS (SELECT {_SITE} AS site, page_id AS ord, {_NORMAL} AS nurl FROM pages),
d AS (SELECT site, nurl, min(ord) AS ord, regexp_extract(nurl, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM u GROUP BY site, nurl),
f AS (SELECT *, list_filter(string_split(lower(path), '/'), lambda s: s <> '') AS segs FROM d),
g AS (SELECT * FROM f WHERE len(segs) > 0 AND NOT list_has_any(segs, {_list(ARCHIVE_SEGMENTS)}) AND NOT regexp_matches(path, '/page/\\d+/?$') AND NOT regexp_matches(path, '(?i)\\.(pdf|jpe?g|png|gif|webp|svg|zip|mp4|mp3|xml|json|css|js|txt)$'))"""

ORACLES = {
    "page_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "page_h1": f"SELECT page_id, h[1] AS h1, CAST(len(h) AS BIGINT) AS n_h1 FROM (SELECT page_id, {_H1S} AS h FROM pages)",
    "page_lang": f"SELECT page_id, {_LANG} AS lang FROM pages",
    "page_main_text_words": f"SELECT page_id, main_text, CAST({_WORDS.format(x='main_text')} AS BIGINT) AS words FROM (SELECT page_id, {_MAIN} AS main_text FROM pages)",
    "page_facts": f"WITH {_FACTS} SELECT w.page_id, title, CAST(NULL AS VARCHAR) AS meta_description, CAST(len(h1s) AS INTEGER) AS n_h1s, 0 AS n_headings, CAST(NULL AS VARCHAR) AS canonical, ',' AS robots, {_LANG} AS lang, 0 AS images_total, 0 AS n_missing_alt, 0 AS insecure_resources, CAST(scripts AS INTEGER) AS script_count, CAST(words AS INTEGER) AS word_count, sha256(main_text) AS main_text_sha256 FROM worded w JOIN pages USING (page_id)",
    "doc_word_count": f"SELECT doc_id, CAST({_WORDS.format(x="coalesce(text, '')")} AS BIGINT) AS words FROM documents",
    "page_issues": f"WITH {_ISSUES} SELECT * FROM found",
    "page_issue_counts": f"WITH {_ISSUES} SELECT page_id, count(code) AS issue_count, count(*) FILTER (WHERE severity = 'error') AS error_count FROM pages LEFT JOIN found USING (page_id) GROUP BY page_id",
    "issue_histogram": f"WITH {_ISSUES} SELECT code, severity, count(*) AS pages FROM found GROUP BY code, severity",
    "title_duplicates": f"WITH {_FACTS} SELECT page_id, site, title, title_count FROM worded WHERE title_count > 1",
    "noindex_directives": "SELECT p_partkey, p_partkey % 50 <> 0 AND (p_partkey % 9 IN (0, 3, 5, 6) OR p_partkey % 4 = 2) AS blocked FROM part",
    "fetch_failures": "SELECT o_orderkey AS page_id, 'http_error' AS code, 'error' AS severity, CASE WHEN o_orderstatus = 'F' THEN 'URL listed in the sitemap returns HTTP 404' ELSE 'URL listed in the sitemap could not be fetched: ' || lower(o_orderpriority) END AS message FROM orders",
    "url_site_key": f"SELECT page_id, {_SITE} AS site FROM pages",
    "url_normalized": f"SELECT page_id, {_NORMAL} AS url FROM pages",
    "url_dedup_per_site": f"SELECT site, n AS url, min(page_id) AS page_id, count(*) AS copies FROM (SELECT page_id, {_SITE} AS site, {_NORMAL} AS n FROM pages) GROUP BY site, n",
    "pages_per_site": f"SELECT {_SITE} AS site, count(*) AS pages FROM pages GROUP BY 1",
    "slug_text": f"SELECT page_id, {_SLUG} AS slug FROM pages",
    "article_shaped": rf"WITH x AS (SELECT p_partkey, '/' || lower(substr(p_type, 1, 4)) || '/' || replace(lower(p_name), ' ', '-') AS path FROM part) SELECT p_partkey, path, len(regexp_extract_all(list_filter(string_split(path, '/'), lambda s: s <> '')[-1], '[-_]')) >= 2 AND len(list_filter(string_split(path, '/'), lambda s: s <> '')) BETWEEN 1 AND 4 AS shaped, list_has_any(string_split(path, '/'), {_list(ARCHIVE_SEGMENTS)}) AS archive FROM x",
    "url_section_share": f"WITH x AS (SELECT {_SITE} AS site, list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS s FROM pages), n AS (SELECT site, s[1] AS segment, count(*) AS n FROM x WHERE len(s) >= 2 GROUP BY ALL) SELECT site, segment, n, round(n / sum(n) OVER (PARTITION BY site), 9) AS share FROM n",
    "website_urls": "SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'https://www.teashop' || s_suppkey || '.com/blog' WHEN 5 THEN 'https://teashop' || s_suppkey || '.com./' WHEN 6 THEN 'http://a' || s_suppkey || '.com/x' WHEN 7 THEN 'https://b.org:' || (s_suppkey + 8000) || '/' END AS url, CASE s_suppkey % 8 WHEN 0 THEN 'https://www.teashop' || s_suppkey || '.com' WHEN 5 THEN 'https://teashop' || s_suppkey || '.com.' WHEN 6 THEN 'http://a' || s_suppkey || '.com' WHEN 7 THEN 'https://b.org:' || (s_suppkey + 8000) END AS origin, CASE s_suppkey % 8 WHEN 0 THEN 'teashop' || s_suppkey || '.com' WHEN 5 THEN 'teashop' || s_suppkey || '.com' WHEN 6 THEN 'a' || s_suppkey || '.com' WHEN 7 THEN 'b.org' END AS site_key FROM supplier",
    "ip_public": f"SELECT o_orderkey, (n >> 24) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) AS ip, NOT ({_BLOCKED}) AS public FROM (SELECT o_orderkey, CAST({_IP_N} AS BIGINT) AS n FROM orders)",
    "doc_phrases": f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_phrases('text', True)}) AS term FROM documents) GROUP BY doc_id, term",
    "term_document_frequency": f"SELECT source, term, count(*) AS df FROM (SELECT doc_id, source, unnest(list_distinct({_phrases('text', False)})) AS term FROM documents) GROUP BY source, term",
    "term_idf": f"WITH t AS (SELECT source, term, count(*) AS df FROM (SELECT source, unnest(list_distinct({_phrases('text', False)})) AS term FROM documents) GROUP BY source, term), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT t.source, term, round(ln((n + 1) / (df + 1)) + 1, 9) AS idf FROM t JOIN n ON t.source = n.source",
    "keyword_candidates": f"WITH {_CANDIDATES} SELECT site, page_id, term, array_to_string(sources, ',') AS sources, body_count FROM cands",
    "keyword_scores": f"WITH {_SCORES} SELECT site, page_id, term, round(score, 9) AS score, array_to_string(sources, ',') AS sources FROM scores WHERE score >= 2",
    "keyword_picks": f"WITH {_SCORES}, ordered AS (SELECT site, page_id, list(term ORDER BY score DESC, term COLLATE en) AS terms FROM scores WHERE score >= 2 GROUP BY site, page_id), kept AS (SELECT site, page_id, list_reduce(list_transform(terms, lambda t: [t]), lambda a, t: CASE WHEN len(a) >= 8 OR len(list_filter(a, lambda k: contains(' ' || k || ' ', ' ' || t[1] || ' ') OR contains(' ' || t[1] || ' ', ' ' || k || ' '))) > 0 THEN a ELSE list_concat(a, t) END) AS terms FROM ordered), ranked AS (SELECT site, page_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS rank_order FROM kept) SELECT r.site, r.page_id, CAST(rank_order AS BIGINT) AS rank_order, r.term, floor(score * 100 + 0.5) / 100 AS score, array_to_string(sources, ',') AS sources FROM ranked r JOIN scores s ON r.page_id = s.page_id AND r.term = s.term",
    "brand_suffix": f"WITH f AS (SELECT page_id, site, CASE WHEN page_id % 4 <> 0 THEN split_part(site, '.', 1) END AS suffix FROM (SELECT page_id, {_SITE} AS site FROM pages)), n AS (SELECT site, count(*) AS pages, count(suffix) AS n, min(suffix) AS suffix FROM f GROUP BY site) SELECT DISTINCT site, w AS word FROM (SELECT site, unnest({_phrases('suffix', True)}) AS w FROM n WHERE n >= 2 AND n >= pages / 2) WHERE NOT contains(w, ' ')",
    "rank_latest": f"WITH {_LATEST} SELECT * FROM latest",
    "rank_best": f"WITH {_LATEST} SELECT user_id, min(position) AS best FROM latest GROUP BY user_id",
    "rank_local_day": f"SELECT event_id, {_LOCAL} AS day FROM events",
    "rank_history_range": f"WITH {_SNAP} SELECT user_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS captured_at, {_LOCAL} AS date, position FROM snaps WHERE {_range('2024-01-10', '2024-01-13')}",
    "rank_history_pivot": f"WITH {_SNAP}, h AS (SELECT user_id, event_type, ts, {_LOCAL} AS date, position FROM snaps WHERE {_range('2024-01-01', '2024-02-01')}), l AS (SELECT user_id, date, event_type, position FROM h QUALIFY row_number() OVER (PARTITION BY user_id, date, event_type ORDER BY ts DESC, position) = 1) SELECT user_id, date, {', '.join(f"max(position) FILTER (WHERE event_type = '{t}') AS {t}" for t in ('click', 'error', 'purchase', 'signup', 'view'))} FROM l GROUP BY user_id, date",
    "rank_series_nested": f"WITH {_SNAP}, h AS (SELECT user_id, event_type, ts, {_LOCAL} AS date, position FROM snaps WHERE {_range('2024-01-10', '2024-01-13')}), g AS (SELECT user_id, event_type, string_agg(date || ':' || coalesce(CAST(position AS VARCHAR), '-'), ' ' ORDER BY ts) AS points FROM h GROUP BY ALL) SELECT user_id, event_type, coalesce(points, '') AS points FROM (SELECT DISTINCT user_id, event_type FROM events) LEFT JOIN g USING (user_id, event_type)",
    "rank_gap_fill": "WITH p AS (SELECT DISTINCT user_id, event_type FROM events), d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS snapshot_date) SELECT user_id, event_type, snapshot_date FROM p, d EXCEPT SELECT user_id, event_type, CAST(ts AS DATE) FROM events",
    "rank_dedupe_daily": f"WITH {_SNAP} SELECT user_id, event_type, CAST(ts AS DATE) AS snapshot_date, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS captured_at, position FROM snaps QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, position) = 1",
    "position_tone": f"WITH {_SNAP} SELECT CASE WHEN position <= 3 THEN 'top' WHEN position <= 10 THEN 'good' WHEN position IS NOT NULL THEN 'low' ELSE 'unranked' END AS tone, count(*) AS n FROM snaps GROUP BY 1",
    "chart_axis": f"WITH {_SNAP}, w AS (SELECT CAST(greatest(1, max(position)) AS BIGINT) AS worst FROM snaps), s AS (SELECT worst, CAST(CASE WHEN worst <= 20 THEN 5 WHEN worst <= 50 THEN 10 ELSE 25 END AS BIGINT) AS step FROM w), b AS (SELECT *, CAST(least(100, ceil((worst + 1) / step) * step) AS BIGINT) AS bottom FROM s) SELECT worst, step, bottom, '1 ' || array_to_string(generate_series(step, bottom, step), ' ') AS ticks FROM b",
    "snapshot_count": f"WITH {_SNAP} SELECT count(*) AS n, count(*) - count(position) AS unranked FROM snaps",
    "pages_list": _pages(),
    "pages_page_n": _pages(limit=50, offset=100),
    "pages_search": _pages(_search("urgent"), 100),
    "pages_search_term": _pages(_search("red bolt"), 100),
    "pages_search_literal": _pages(_search("%"), 100).replace(_TABLES, _SIGNS),
    "pages_count": f"WITH {_TABLES} SELECT count(*) AS total, count(*) FILTER (WHERE {_search('urgent')}) AS urgent FROM p JOIN c ON c.id = p.client_id WHERE c.user_id = 3",
    "page_detail_keywords": f"WITH {_TABLES} SELECT page_id, k.id, term, score, position, date FROM pk JOIN p ON p.id = page_id JOIN k ON k.id = keyword_id LEFT JOIN lt ON page_keyword_id = pk.id",
    "page_detail_issues": f"WITH {_TABLES} SELECT page_id, string_agg(code, ',' ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, code) AS codes FROM i GROUP BY page_id",
    "client_list": "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey = 3",
    "client_keyword_counts": f"WITH {_TABLES} SELECT client_id, count(*) AS keywords FROM pk JOIN p ON p.id = page_id GROUP BY client_id",
    "rank_pairs": f"WITH {_TABLES} SELECT pk.id, rank_order, url, term FROM pk JOIN p ON p.id = page_id JOIN k ON k.id = keyword_id",
    "crawl_outcome": "SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> 'F') AS analysed, CASE WHEN bool_and(o_orderstatus <> 'F') THEN 'done' ELSE 'partial' END AS status, CASE WHEN NOT bool_and(o_orderstatus <> 'F') THEN count(*) FILTER (WHERE o_orderstatus = 'F') || ' of ' || count(*) || ' pages could not be analysed' END AS message FROM orders GROUP BY o_custkey",
    "fetch_outcome": "SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 OR o_orderkey % 6 IN (2, 4) THEN 'blocked' WHEN o_orderkey % 6 IN (3, 5) OR o_orderkey % 5 = 0 THEN 'failed' ELSE 'ok' END AS outcome FROM orders",
    "consecutive_blocks": "WITH b AS (SELECT event_id, user_id, ts, CAST(event_type = 'error' AS INTEGER) AS b, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM b) SELECT event_id, CAST(run AS BIGINT) AS run, coalesce(bool_or(run >= 3) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM r",
    "state_requeue": f"WITH {_CLIENTS} SELECT id, CASE WHEN status IN ('discovering', 'crawling') AND (beat IS NULL OR beat < 500000) THEN 'pending' ELSE status END AS crawl_status FROM cl",
    "state_claim": f"WITH {_CLIENTS} SELECT id, CASE WHEN id = 6 AND status = 'pending' THEN 'discovering' WHEN id = 9 AND user_id = 9 AND status IN ('done', 'partial', 'failed') THEN 'pending' ELSE status END AS crawl_status, CAST(CASE WHEN id = 6 AND status = 'pending' THEN 0 ELSE 15 END AS BIGINT) AS pages_total, CAST(CASE WHEN id = 6 AND status = 'pending' THEN 0 ELSE 3 END AS BIGINT) AS pages_done FROM cl",
    "state_pending": f"WITH {_CLIENTS} SELECT id FROM cl WHERE status = 'pending'",
    "crawl_queue": "WITH f AS (SELECT user_id AS client_id, min(ts) AS t FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT client_id, row_number() OVER (ORDER BY t, client_id) AS place, row_number() OVER (ORDER BY t, client_id) <= 2 AS running FROM f",
    "session_active": "SELECT user_id, count(*) AS active, count(*) FILTER (WHERE ts + INTERVAL 7 DAY <= TIMESTAMP '2024-01-20' + INTERVAL 84 HOUR) AS renewable FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20' GROUP BY user_id",
    "login_limit": "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 3, event_id // 60 ORDER BY event_id) <= 5",
    "replace_keyword_set": "WITH o AS (SELECT l_orderkey AS page_id, l_partkey AS keyword_id, max(l_quantity) AS score FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY ALL), n AS (SELECT l_orderkey AS page_id, l_partkey AS keyword_id, max(l_quantity) AS score FROM lineitem WHERE l_linenumber % 3 <> 1 GROUP BY ALL), a AS (SELECT o_orderkey AS page_id FROM orders WHERE o_orderstatus <> 'F') SELECT page_id, keyword_id, page_id * 1000000 + keyword_id AS id, score FROM o WHERE page_id NOT IN (SELECT page_id FROM a) UNION ALL SELECT n.page_id, n.keyword_id, CASE WHEN o.page_id IS NOT NULL THEN n.page_id * 1000000 + n.keyword_id END, n.score FROM n LEFT JOIN o ON o.page_id = n.page_id AND o.keyword_id = n.keyword_id WHERE n.page_id IN (SELECT page_id FROM a)",
    "upsert_pages": "SELECT o_orderkey AS url, CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE 'X' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS title FROM orders",
    "insert_ignore_terms": "SELECT DISTINCT p_name || CASE WHEN p_size > 25 THEN ' x' ELSE '' END AS term FROM part EXCEPT SELECT p_name FROM part WHERE p_partkey % 2 = 0",
    "replace_issues": f"WITH {_TABLES} SELECT page_id, code, severity FROM i WHERE page_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT o_orderkey, 'http_error', 'error' FROM orders WHERE o_orderstatus = 'O'",
    "hub_link_scores": f"WITH a AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+') AS o, regexp_extract_all(html, '(?i)<a href=\"(/[^\"]*)\"', 1) AS h FROM pages), l AS (SELECT page_id, o, unnest(h) AS p, generate_subscripts(h, 1) - 1 AS ord FROM a), n AS (SELECT page_id, ord, o || p AS url FROM l) SELECT page_id, CAST(ord AS BIGINT) AS ord, {_NORMAL} AS target, CAST(CASE WHEN ord % 2 = 0 THEN 4 ELSE 3 END + CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS score FROM n WHERE {_PATH} <> '/'",
    "page_anchors": "SELECT page_id, n AS links, n AS in_nav FROM (SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=')) AS BIGINT) AS n FROM pages) WHERE n > 0",
    "select_posts": f"WITH {_POSTS} SELECT site, row_number() OVER (PARTITION BY site ORDER BY ord) AS post, nurl AS url FROM g QUALIFY post <= 15",
    "sitemap_source": f"SELECT site, 'urlset' AS kind, ord, loc FROM (SELECT {_SITE} AS site, row_number() OVER (PARTITION BY {_SITE} ORDER BY page_id) - 1 AS ord, url AS loc FROM pages) WHERE ord < 500",
    "robots_allowed": f"SELECT allowed, 2.0::DOUBLE AS crawl_delay, count(*) AS urls FROM (SELECT NOT starts_with(path, '/en/') OR starts_with(path, '/en/6') AS allowed FROM (SELECT {_PATH} AS path FROM pages)) GROUP BY allowed",
}


def _fnv(x: str) -> str:
    """FNV-1a of a text, step by step."""
    return f"list_reduce(list_transform(string_split({x}, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT))"


def _draws(source: str, columns: str) -> str:
    """Common tables d0 to d2 that end in the numbers r of source(columns, seed, k)."""
    step = lambda a, b: f"CAST((CAST({a} AS HUGEINT) * CAST({b} AS HUGEINT)) % 4294967296 AS BIGINT)"
    return f"""{source}0 AS (SELECT {columns}, k, (seed + k * 1831565813) % 4294967296 AS st FROM {source}),
{source}1 AS (SELECT {columns}, k, {step("xor(st, st >> 15)", "(st | 1)")} AS t FROM {source}0),
{source}2 AS (SELECT {columns}, k, xor((t + {step("xor(t, t >> 7)", "(t | 61)")}) % 4294967296, t) AS u FROM {source}1),
{source}3 AS (SELECT {columns}, k, xor(u, u >> 14) / 4294967296.0::DOUBLE AS r FROM {source}2)"""


def _generated(pairs: str, keys: str, first: str, n_days: int) -> str:
    """pos(keys, day, position) from pairs(keys, seed, rank_order): the walk day by day."""
    return f"""{pairs},
cal AS (SELECT CAST(i AS BIGINT) AS i, DATE '{first}' + CAST(i AS INTEGER) AS day FROM range({n_days}) AS x(i)),
u AS (SELECT i, day, {_fnv("'update:' || CAST(day AS VARCHAR)")} AS seed, CAST(1 AS BIGINT) AS k FROM cal), {_draws("u", "i, day")},
days AS (SELECT i, day, CAST(r < 0.02 AS BIGINT) AS up, coalesce(sum(CAST(r < 0.02 AS BIGINT)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u3),
need AS (SELECT {keys}, seed, CAST(k AS BIGINT) AS k FROM pairs, range(1, {5 * n_days + 8}) AS x(k)), {_draws("need", keys)},
d AS (SELECT {keys}, list(r ORDER BY k) AS r FROM need3 GROUP BY {keys}),
base AS (SELECT pairs.*, d.r, least(90.0::DOUBLE, 2 + rank_order * 6 + d.r[1] * 15) AS base, CASE WHEN d.r[2] < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS way FROM pairs JOIN d USING ({keys})),
steps AS (SELECT {keys}, base, way, r[3] AS begin, i, day, up, r[k0 + 1] + r[k0 + 2] + r[k0 + 3] AS walk, r[k0 + 4] AS jump, r[k0 + 4 + up] AS shown FROM (SELECT *, CAST(3 + 4 * i + before AS BIGINT) AS k0 FROM base, days)),
walked AS (SELECT {keys}, i, day, up, walk, jump, shown, base, way, base + (begin - 0.5::DOUBLE) * 10 AS p0 FROM steps),
pos({keys}, i, day, p, shown) AS (
SELECT {keys}, CAST(-1 AS BIGINT), CAST(NULL AS DATE), p0, 0.0::DOUBLE FROM walked WHERE i = 0
UNION ALL SELECT {", ".join(f"w.{k.strip()}" for k in keys.split(","))}, w.i, w.day, least(100.0::DOUBLE, greatest(1.0::DOUBLE, (pos.p + (0.15::DOUBLE * (w.base - pos.p) + (w.walk - 1.5::DOUBLE) * 2)) + CASE WHEN w.up = 1 THEN w.way * (5 + w.jump * 10) ELSE 0 END)), w.shown FROM pos JOIN walked w ON w.i = pos.i + 1 AND {" AND ".join(f"w.{k.strip()} = pos.{k.strip()}" for k in keys.split(","))})"""


_POSITION = "CASE WHEN shown >= 0.05 THEN CAST(floor(p + 0.5) AS INTEGER) END AS position"
ORACLES["rank_generator"] = f"WITH RECURSIVE {_generated(f'pairs AS (SELECT p_partkey AS pair_id, p_size % 8 + 1 AS rank_order, {_fnv(chr(39) + 'https://a.example/|' + chr(39) + ' || p_name')} AS seed FROM part)', 'pair_id', '2026-08-09', 60)} SELECT pair_id, day AS snapshot_date, strftime(day, '%Y-%m-%d') || 'T02:30:00Z' AS captured_at, {_POSITION} FROM pos WHERE i >= 0"
ORACLES["rank_generated_gaps"] = f"WITH RECURSIVE {_generated(f'pairs AS (SELECT user_id, event_type, 1 AS rank_order, {_fnv("user_id || '|' || event_type")} AS seed FROM (SELECT DISTINCT user_id, event_type FROM events))', 'user_id, event_type', '2024-01-01', 30)} SELECT user_id, event_type, day AS snapshot_date, {_POSITION} FROM pos WHERE i >= 0 AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = pos.user_id AND e.event_type = pos.event_type AND CAST(e.ts AS DATE) = day)"

_MAPS = f"""listed AS (SELECT {_SITE} AS site, page_id, url, CASE page_id % 3 WHEN 0 THEN '2' WHEN 1 THEN '' ELSE 'p' END AS map, {_PATH} AS path FROM pages),
sized AS (SELECT site, map, count(*) AS n, count(*) FILTER (WHERE len(list_filter(string_split(path, '/'), lambda s: s <> '')) BETWEEN 1 AND 4 AND (len(regexp_extract_all(list_filter(string_split(path, '/'), lambda s: s <> '')[-1], '[-_]')) >= 2 OR regexp_matches(path, '/[0-9]{{4}}/[0-9]{{2}}/'))) AS shaped FROM listed GROUP BY site, map)"""
ORACLES["sitemap_family_score"] = f"""WITH {_MAPS}, fam AS (SELECT site, map = 'p' AS product, count(*) AS members, min_by(n, map) AS n, min_by(shaped, map) AS shaped FROM sized GROUP BY ALL)
SELECT site, 'https://' || site || CASE WHEN product THEN '/product-sitemap.xml' ELSE '/post-sitemap.xml' END AS family, members, CAST(CASE WHEN product THEN -30 ELSE 15 END AS BIGINT) AS prior, n, CASE WHEN NOT product OR shaped / n >= 0.6 THEN round(CASE WHEN product THEN -30 ELSE 15 END + CASE WHEN shaped / n >= 0.6 THEN 10 ELSE 0 END + least(10.0::DOUBLE, log2(n + 1)), 9) END AS score FROM fam"""
ORACLES["discover_blog"] = f"""WITH {_MAPS}, {_POSTS.replace("FROM pages)", "FROM (SELECT l.url, CASE WHEN l.map = '' THEN 0 ELSE 100000000 END + l.page_id AS page_id FROM listed l LEFT JOIN sized z ON z.site = l.site AND z.map = '' WHERE l.map = '' OR l.map = '2' AND coalesce(z.n, 0) < 45))", 1)}
SELECT site, 1 AS round, row_number() OVER (PARTITION BY site ORDER BY ord) AS post, nurl AS url FROM g QUALIFY post <= 15"""

ORACLES["crawl_error_texts"] = "SELECT c_custkey, ['The website took too long to respond.', 'No sitemap was found: none listed in robots.txt works and the usual locations are missing.', 'The website address is not valid.', NULL][c_custkey % 4 + 1] AS reason FROM customer"
ORACLES["pick_source_labels"] = f"SELECT CASE s WHEN 'h1' THEN 'H1' WHEN 'slug' THEN 'URL' WHEN 'body' THEN 'body text' ELSE s END AS label, count(*) AS picks FROM (SELECT unnest(string_split(sources, ',')) AS s FROM ({ORACLES['keyword_picks']})) GROUP BY 1"

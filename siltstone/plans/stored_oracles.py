"""DuckDB SQL for the queries over stored tables, streams and sources: what has to come out, whatever the way."""

from __future__ import annotations

from siltstone.plans.made_oracles import _FOUND, _MADE, _REFUSED, _RULES, _TARGETS
from siltstone.plans.oracles import _SIGNS, _SNAP, ORACLES
from siltstone.plans.stored import SEARCHES

_COLUMNS = {"user_id": ("count(DISTINCT user_id)", "CAST(min(user_id) AS VARCHAR)", "CAST(max(user_id) AS VARCHAR)"), "event_type": ("count(DISTINCT event_type)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"), "position": ("count(DISTINCT position)", "CAST(min(position) AS VARCHAR)", "CAST(max(position) AS VARCHAR)"), "snapshot_date": ("count(DISTINCT CAST(ts AS DATE))", "CAST(CAST(min(ts) AS DATE) AS VARCHAR)", "CAST(CAST(max(ts) AS DATE) AS VARCHAR)")}
_FURTHER = [
    ("few_headings", "notice", "len(headings) < 2 AND words > 300", "len(headings) || ' headings for ' || words || ' words'", "{'words': words}"),
    ("no_site_name", "warning", "NOT contains(lower(coalesce(title, '')), 'shop')", "'Title doesn''t name the shop'", None),
    ("thin_content", "error", "words < 100", "'Fewer than 100 words: ' || words", None),
]


def _rules(rules) -> str:
    return " UNION ALL ".join(f"SELECT page_id, '{code}' AS code, '{severity}' AS severity, {message} AS message, {f'CAST(to_json({details}) AS VARCHAR)' if details else 'CAST(NULL AS VARCHAR)'} AS details FROM counted WHERE {when}" for code, severity, when, message, details in rules)


assert _rules(_RULES) == _FOUND

STORED_ORACLES = {
    "source_refusals": f"SELECT DISTINCT {_TARGETS} AS url, CAST(NULL AS INTEGER) AS status, {_REFUSED} AS error FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) WHERE k % 8 BETWEEN 1 AND 5",
    "stale_heartbeats": "WITH b AS (SELECT DISTINCT user_id, 1704067200000 + (epoch_us(ts) // 1000 - 1704067200000) // 360 AS ms FROM events), n AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms) AS following, max(ms) OVER () - 600000 AS passed FROM b) SELECT user_id, strftime(make_timestamp_ms(ms), '%Y-%m-%d %H:%M:%S.%g') AS last_beat, strftime(make_timestamp_ms(ms + 120000), '%Y-%m-%d %H:%M:%S.%g') AS stale_at FROM n WHERE coalesce(following > ms + 120000, true) AND ms + 120000 <= passed",
    "swept_sessions": "WITH s AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS a, epoch_us(ts) // 1000 + 32400000 AS e, max(epoch_us(ts) // 1000) OVER () - 600000 AS passed FROM events), t AS (SELECT *, (e + 3599999) // 3600000 * 3600000 AS swept FROM s) SELECT user_id, strftime(make_timestamp_ms(max(e)), '%Y-%m-%d %H:%M:%S') AS ended_at, strftime(make_timestamp_ms(swept), '%Y-%m-%d %H:%M:%S') AS swept_at FROM t WHERE swept <= passed AND NOT EXISTS (SELECT 1 FROM t o WHERE o.user_id = t.user_id AND o.a <= t.swept AND o.e > t.swept) GROUP BY user_id, swept",
    "ingested_snapshots": ORACLES["rank_dedupe_daily"],
    "ingested_latest": ORACLES["rank_latest"],
    "rank_latest_kept": ORACLES["rank_latest"],
    "stored_page_upserts": ORACLES["upsert_pages"],
    "stored_issue_replacement": ORACLES["replace_issues"],
    "stored_keyword_sets": ORACLES["replace_keyword_set"],
    "snapshot_statistics": f"WITH {_SNAP} " + " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) AS rows, {'count(*) - count(position)' if c == 'position' else 'CAST(0 AS BIGINT)'} AS nulls, {n} AS counted, true AS close, {low} AS least, {high} AS greatest FROM snaps" for c, (n, low, high) in _COLUMNS.items()),
    "pages_list_stored": ORACLES["pages_list"],
    "pages_page_n_stored": ORACLES["pages_page_n"],
    "pages_search_stored": ORACLES["pages_search_term"],
    "pages_search_indexed": ORACLES["pages_search"],
    "indexed_searches": f"WITH {_SIGNS}, q AS (SELECT unnest([{', '.join(repr(x) for x in SEARCHES)}]) AS q), hits AS (SELECT q, page_id FROM pk JOIN k ON k.id = keyword_id JOIN q ON contains(lower(term), lower(q))) SELECT q, p.id FROM p JOIN c ON c.id = client_id JOIN q ON contains(lower(url), lower(q)) OR EXISTS (SELECT 1 FROM hits WHERE hits.q = q.q AND page_id = p.id) WHERE user_id = 3",
    "further_rules": f"WITH {_MADE}, counted AS (SELECT *, page_id % 6 AS k0, count(title) OVER (PARTITION BY site, title) AS copies FROM facts) {_rules([r for r in _RULES if r[0] != 'thin_content'] + _FURTHER)}",
}

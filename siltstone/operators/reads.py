"""Read queries: searched and paged lists with their latest positions, details, and client lists, by owner."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.errors import InvalidRequest
from siltstone.functions.constants import MAX_PAGE_SIZE, MAX_QUERY, PAGE_SIZE
from siltstone.functions.dates import iso_utc
from siltstone.functions.lineage import cut
from siltstone.operators.ranks import latest_positions

_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
ORDER = ["client_name", "client_id", "sitemap_position", "id"]


@dataclass
class Tables:
    """The relations that reads need, with the columns of schema.py."""

    clients: DataFrame
    pages: DataFrame
    page_keywords: DataFrame
    keywords: DataFrame
    seo_issues: DataFrame
    rank_snapshots: DataFrame


def is_uuid(value: Column) -> Column:
    """Whether a text has the form of an id; other texts are ids of nothing."""
    return F.coalesce(value.rlike(_UUID), F.lit(False))


BAD_PAGE, BAD_SEARCH = f"page starts at 1, page_size is 1 to {MAX_PAGE_SIZE}", f"a search has at most {MAX_QUERY} characters"


def checked_paging(page: int, page_size: int, q: str | None) -> str | None:
    """The search text, trimmed, null if empty; InvalidRequest, a ValueError, outside the limits."""
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise InvalidRequest(BAD_PAGE, {"page": page, "page_size": page_size})
    q = (q or "").strip()
    if len(q) > MAX_QUERY:
        raise InvalidRequest(BAD_SEARCH, {"length": len(q)})
    return q or None


def paging_error(page: Column, page_size: Column, q: Column) -> Column:
    """What checked_paging has against a request, for requests in rows; null for valid ones. Nulls are what wasn't asked for."""
    size = F.coalesce(page_size, F.lit(PAGE_SIZE))
    return F.when((F.coalesce(page, F.lit(1)) < 1) | ~size.between(1, MAX_PAGE_SIZE), BAD_PAGE).when(F.char_length(F.trim(q)) > MAX_QUERY, BAD_SEARCH)


def matching_pages(t: Tables, user: str, client: str | None = None, q: str | None = None) -> DataFrame:
    """A user's pages with client_name; with q those whose URL or one of whose terms holds it, case apart, literally."""
    own = t.clients.where(F.col("user_id") == user).select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    if client is not None:
        own = own.where(F.col("client_id") == client)
    found = t.pages.join(own, "client_id")
    if q is None:
        return found
    holds = lambda c: F.contains(F.lower(c), F.lit(q.lower()))
    terms = t.keywords.where(holds(F.col("term"))).select(F.col("id").alias("keyword_id"))
    by_term = t.page_keywords.join(terms, "keyword_id", "left_semi").select(F.col("page_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return found.join(by_term, "id", "left").where(holds(F.col("url")) | F.col("_hit").isNotNull()).drop("_hit")


def count_pages(t: Tables, user: str, client: str | None = None, q: str | None = None) -> DataFrame:
    return matching_pages(t, user, client, q).agg(F.count(F.lit(1)).alias("total"))


def _keyword_lists(t: Tables, of: DataFrame, zone: str, *extra: str) -> DataFrame:
    """(page_id, keywords): the ordered keywords of the pages of(page_id) with their latest positions."""
    pairs = t.page_keywords.join(of, "page_id", "left_semi")
    pairs = pairs.join(t.keywords.select(F.col("id").alias("keyword_id"), "term"), "keyword_id").select(F.col("id").alias("page_keyword_id"), "page_id", "keyword_id", "term", "rank_order", "score", "sources")
    snapshots = t.rank_snapshots.join(pairs.select("page_keyword_id"), "page_keyword_id", "left_semi")
    latest = latest_positions(pairs, snapshots, zone, ["page_keyword_id"])
    rows = F.array_sort(F.collect_list(F.struct("rank_order", "page_keyword_id", F.struct(F.col("keyword_id").alias("id"), "term", *extra, "position", "date").alias("k"))))
    return latest.groupBy("page_id").agg(F.transform(rows, lambda r: r["k"]).alias("keywords"))


def list_pages(t: Tables, user: str, zone: str, client: str | None = None, q: str | None = None, page: int = 1, page_size: int = PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """One page of a user's list, in order: counts of issues, keywords with latest positions, best position.

    The page is cut first, at most MAX_PAGE_SIZE rows, whose ids then go to every scan of issues, keywords and snapshots.
    Past the end there are no rows. after, the ORDER values of the last row of a page, gives the page behind it without
    counting through those before.
    """
    q = checked_paging(page, page_size, q)
    return listed(t, matching_pages(t, user, client, q), zone, page, page_size, after)


def listed(t: Tables, found: DataFrame, zone: str, page: int = 1, page_size: int = PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """One page of the list of the pages found, as list_pages gives it; how they were found doesn't matter."""
    rows = found.select("id", "url", "title", "fetch_status", "client_id", "client_name", "sitemap_position")
    if after is not None:
        rows = rows.where(F.struct(*ORDER) > F.struct(*[F.lit(x).cast(rows.schema[c].dataType).alias(c) for c, x in zip(ORDER, after, strict=True)]))
    rows = cut(rows.orderBy(*ORDER).offset((page - 1) * page_size).limit(page_size))
    of = F.broadcast(rows.select(F.col("id").alias("page_id")))  # at most MAX_PAGE_SIZE ids
    counts = t.seo_issues.join(of, "page_id", "left_semi").groupBy(F.col("page_id").alias("id")).agg(F.count(F.lit(1)).alias("issue_count"), F.count_if(F.col("severity") == "error").alias("error_count"))
    lists = _keyword_lists(t, of, zone).withColumnRenamed("page_id", "id")
    found = rows.join(counts, "id", "left").join(lists, "id", "left")
    best = F.array_min(F.transform("keywords", lambda k: k["position"]))
    return found.orderBy(*ORDER).select("id", "url", "title", "fetch_status", "client_id", "client_name", F.coalesce("issue_count", F.lit(0)).alias("issue_count"), F.coalesce("error_count", F.lit(0)).alias("error_count"), "keywords", best.alias("best_position"))


def page_details(t: Tables, rows: DataFrame, zone: str) -> DataFrame:
    """rows of matching_pages with fetched_at as text, keywords (with latest positions, in order) and issues (errors first, then by code)."""
    of = rows.select(F.col("id").alias("page_id"))
    lists = _keyword_lists(t, of, zone, "score", "sources").withColumnRenamed("page_id", "id")
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    issues = t.seo_issues.join(of, "page_id", "left_semi").groupBy(F.col("page_id").alias("id"))
    issues = issues.agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "code", "severity", "message", "details"))), lambda i: i.dropFields("r")).alias("issues"))
    return rows.join(lists, "id", "left").join(issues, "id", "left").withColumn("fetched_at", iso_utc(F.col("fetched_at")))


def page_detail(t: Tables, user: str, page_id: str, zone: str) -> DataFrame:
    """The details of one page if the user owns it; else no row, and none for a text that is no id."""
    return page_details(t, matching_pages(t, user).where((F.col("id") == page_id) & is_uuid(F.lit(page_id))), zone)


def list_clients(clients: DataFrame, user: str) -> DataFrame:
    return clients.where(F.col("user_id") == user).orderBy("name", "created_at")


def last_page(total: Column, page_size: int = PAGE_SIZE) -> Column:
    """The number of the last page of a list; an empty list has one."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(total / page_size))


def client_keyword_counts(t: Tables) -> DataFrame:
    """(client_id, keywords): pairs by client."""
    return t.page_keywords.join(t.pages.select(F.col("id").alias("page_id"), "client_id"), "page_id").groupBy("client_id").agg(F.count(F.lit(1)).alias("keywords"))


def all_pairs(t: Tables) -> DataFrame:
    """(id, rank_order, url, term) of every pair, by id."""
    return t.page_keywords.join(t.pages.select(F.col("id").alias("page_id"), "url"), "page_id").join(t.keywords.select(F.col("id").alias("keyword_id"), "term"), "keyword_id").select("id", "rank_order", "url", "term").orderBy("id")

"""State as functions from tables to tables: upserts, replacements, claims, requeues and sessions.

Plain Parquet has no MERGE; each function returns the whole next state, which the caller writes beside the old one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siltstone.functions.constants import DEFAULT_DELAY_MS, MAX_DELAY_MS
from siltstone.functions.lineage import cut
from siltstone.functions.text import normalize_email, token_id
from siltstone.functions.urls import parse_website


def upsert(existing: DataFrame, rows: DataFrame, key: list[str], keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """existing with rows put over it by key; columns in keep, and those that rows lack, stay as they were.

    Rows are unique by key.
    """
    a, b = existing.alias("a"), rows.withColumn("_new", F.lit(True)).alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full_outer")

    def column(c: str) -> Column:
        if c not in rows.columns:
            return F.col(f"a.{c}")
        if c in key or c in keep:
            return F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
        return F.when(F.col("b._new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)

    return both.select(*map(column, existing.columns))


def insert_ignore(existing: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows that may be appended: those whose key is not there; one row a key."""
    return rows.dropDuplicates(key).join(existing.select(*key), key, "left_anti").select(*rows.columns)


def upsert_users(users: DataFrame, rows: DataFrame) -> DataFrame:
    """users(id, email, password_hash, timezone, ...) with rows(id, email, password_hash, timezone) put over them by mail address.

    Addresses are normalised. A known user gets the new password and nothing else; an unknown one is added.
    """
    new = rows.withColumn("email", normalize_email(F.col("email")))
    return upsert(users, new, ["email"], keep=tuple(c for c in users.columns if c not in ("email", "password_hash")))


def insert_clients(clients: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows(user_id, name, website_url) that become clients: of valid websites that the user doesn't have yet."""
    site = parse_website(F.col("website_url"))
    new = rows.withColumn("_w", site).where("_w is not null").select("user_id", "name", F.col("_w.url").alias("website_url"), F.col("_w.site_key").alias("site_key"))
    return insert_ignore(clients, new, ["user_id", "site_key"])


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """rows with their place in an order, which is total: sorted over all partitions, numbered within each.

    Only the row counts of the partitions reach the driver; no task holds more than a batch. The one shuffle is the sort:
    the sorted rows are kept, and numbered where they lie.
    """
    sorted_rows = cut(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dict(sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = {}, start
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]

    def number(batches):
        at = None
        for batch in batches:
            if batch.num_rows:
                at = before[batch.column("_part")[0].as_py()] if at is None else at
                kept = [c for c in batch.schema.names if c != "_part"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(range(at, at + batch.num_rows), pa.int64())], names=[*kept, name])
                at += batch.num_rows

    return sorted_rows.mapInArrow(number, StructType([*rows.schema.fields, StructField(name, LongType())]))


def add_terms(keywords: DataFrame, picks: DataFrame) -> DataFrame:
    """keywords(id, term) with the terms of picks(term) that are new, numbered on in their order."""
    new = insert_ignore(keywords.select("term"), picks.select("term"), ["term"])
    last = keywords.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return keywords.select("id", "term").unionByName(numbered(new, ["term"], "id", last + 1).select("id", "term"))


def save_analysis(keywords: DataFrame, page_keywords: DataFrame, seo_issues: DataFrame, picks: DataFrame, issues: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keywords, page_keywords, seo_issues) after an analysis of pages(page_id, fetched).

    picks(page_id, term, score, rank_order, sources) and issues(page_id, code, severity, message, details) are those of the
    analysis. Terms that are new get an id; pairs of fetched pages become their picks, and pairs that survive keep their
    id, and with it their history. Issues of all pages are replaced. A page that wasn't fetched keeps its pairs.
    """
    terms = cut(add_terms(keywords, picks))
    named = picks.join(terms.select(F.col("id").alias("keyword_id"), "term"), "term").drop("term")
    return terms, replace_keyword_set(page_keywords, named, pages.where("fetched").select("page_id")), replace_issues(seo_issues, issues, pages)


def replace_keyword_set(existing: DataFrame, picks: DataFrame, analysed: DataFrame) -> DataFrame:
    """page_keywords after an analysis: pairs of analysed pages become the picks, survivors keep their id.

    existing(id, page_id, keyword_id, score, rank_order, sources), picks the same without id, analysed(page_id). New pairs
    have a null id until the store gives one. Pages that were not analysed keep their pairs.
    """
    untouched = existing.join(analysed, "page_id", "left_anti").select(*existing.columns)
    ids = existing.select("page_id", "keyword_id", "id")
    now = picks.join(analysed, "page_id", "left_semi").join(ids, ["page_id", "keyword_id"], "left").select(*existing.columns)
    return untouched.unionByName(now)


def replace_issues(existing: DataFrame, issues: DataFrame, pages: DataFrame) -> DataFrame:
    """Issues after a crawl: those of the given pages are replaced, others stay."""
    return existing.join(pages.select("page_id").distinct(), "page_id", "left_anti").select(*existing.columns).unionByName(issues.select(*existing.columns))


def claim_crawl(clients: DataFrame, client_id, now: Column) -> DataFrame:
    """clients with a pending one moved to discovering and its counters reset; any other status is left alone."""
    hit = (F.col("id") == client_id) & (F.col("crawl_status") == "pending")
    values = {"crawl_status": F.lit("discovering"), "crawl_started_at": now, "crawl_heartbeat_at": now, "crawl_finished_at": F.lit(None), "crawl_error_code": F.lit(None), "crawl_error_message": F.lit(None), "pages_total": F.lit(0), "pages_done": F.lit(0)}
    return clients.withColumns({c: F.when(hit, v.cast(clients.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items() if c in clients.columns})


def requeue_stale(clients: DataFrame, stale_before: Column) -> DataFrame:
    """clients with crawls whose heartbeat is missing or too old back at pending."""
    stale = F.col("crawl_status").isin("discovering", "crawling") & (F.col("crawl_heartbeat_at").isNull() | (F.col("crawl_heartbeat_at") < stale_before))
    return clients.withColumn("crawl_status", F.when(stale, "pending").otherwise(F.col("crawl_status")))


def requeue_client(clients: DataFrame, client_id, user) -> DataFrame:
    """clients with a user's finished crawl back at pending, its error forgotten."""
    hit = (F.col("id") == client_id) & (F.col("user_id") == user) & F.col("crawl_status").isin("done", "partial", "failed")
    values = {"crawl_status": F.lit("pending"), "crawl_error_code": F.lit(None).cast("string"), "crawl_error_message": F.lit(None).cast("string")}
    return clients.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items() if c in clients.columns})


def resume(clients: DataFrame, stale_before: Column) -> tuple[DataFrame, DataFrame]:
    """(clients, their queue) after a restart: crawls without a live owner are pending again, oldest client first."""
    after = requeue_stale(clients, stale_before)
    return after, pending(after)


def pending(clients: DataFrame) -> DataFrame:
    return clients.where(F.col("crawl_status") == "pending").select("id", "created_at").orderBy("created_at")


def crawl_queue(requests: DataFrame, concurrency: int = 2) -> DataFrame:
    """(client_id, place, running): first come first served, one entry a client."""
    first = requests.groupBy("client_id").agg(F.min("requested_at").alias("requested_at"))
    return numbered(first, ["requested_at", "client_id"], "place").select("client_id", "place", (F.col("place") <= concurrency).alias("running"))


def crawl_outcome(pages: DataFrame, client: str) -> DataFrame:
    """(client, total, analysed, status, message): done if every page was analysed, else partial."""
    n = pages.groupBy(client).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("fetch_status") == "ok").alias("analysed"))
    whole = F.col("total") == F.col("analysed")
    return n.select(client, "total", "analysed", F.when(whole, "done").otherwise("partial").alias("status"), F.when(~whole, F.format_string("%d of %d pages could not be analysed", F.col("total") - F.col("analysed"), F.col("total"))).alias("message"))


def fetch_outcome(status: Column, content_type: Column, mitigated: Column) -> Column:
    """ok, blocked or failed for an answer."""
    return F.when(status.isin(403, 429) | mitigated.isNotNull(), "blocked").when((status >= 400) | ~F.coalesce(F.lower(content_type).contains("html"), F.lit(False)), "failed").otherwise("ok")


def consecutive_blocks(rows: DataFrame, group: str, order: list[str], blocked: Column, limit: int = 3) -> DataFrame:
    """rows with run (how many blocked ones in a row end here) and stopped (an earlier run reached the limit)."""
    w = Window.partitionBy(group).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_b", blocked.cast("int")).withColumn("_island", F.sum(1 - F.col("_b")).over(upto))
    found = found.withColumn("run", F.sum("_b").over(Window.partitionBy(group, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("stopped", F.coalesce(F.max(F.col("run") >= limit).over(before), F.lit(False))).drop("_b", "_island")


def live_sessions(sessions: DataFrame, users: DataFrame, now: Column, ttl_days: int = 7) -> DataFrame:
    """sessions(id, user_id, expires_at) that are not over, with user columns and renewed: the end is moved when half is gone."""
    found = sessions.where(F.col("expires_at") > now).join(users.withColumnRenamed("id", "user_id"), "user_id")
    half = F.col("expires_at") <= now + F.expr(f"INTERVAL {ttl_days * 12} HOURS")
    return found.withColumn("renewed", half).withColumn("expires_at", F.when(half, now + F.expr(f"INTERVAL {ttl_days} DAYS")).otherwise(F.col("expires_at")))


def active_session(sessions: DataFrame, users: DataFrame, token: str, now: Column, ttl_days: int = 7) -> DataFrame:
    """The live session of a token, of which only the digest is stored; no row if it is over or unknown."""
    return live_sessions(sessions.where(F.col("id") == token_id(F.lit(token))), users, now, ttl_days)


def purge_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > now)


def purged_count(sessions: DataFrame, now: Column) -> DataFrame:
    """(deleted): how many sessions a purge removes."""
    return sessions.agg(F.count_if(F.col("expires_at") <= now).alias("deleted"))


def limited_logins(attempts: DataFrame, limit: int = 5) -> DataFrame:
    """attempts(ip, email, ts) with allowed: at most limit a minute by address and normalised mail."""
    w = Window.partitionBy("ip", F.lower(F.trim("email")), F.date_trunc("minute", "ts")).orderBy("ts")
    return attempts.withColumn("allowed", F.row_number().over(w) <= limit)


def polite_delay_ms(crawl_delay_seconds: Column) -> Column:
    """Pause between requests to a site: what robots.txt asks for, else a default, up to a limit."""
    return F.least(F.coalesce(crawl_delay_seconds * 1000, F.lit(DEFAULT_DELAY_MS)), F.lit(MAX_DELAY_MS))

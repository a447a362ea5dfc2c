"""Queries over stored tables, streams and sources: what is kept up to date, read by index or layout, or fetched.

Each writes what it needs below the shared folder, from the given tables, and removes it when its rows are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions import dates
from siltstone.functions.lineage import cut, remove, shared_dir
from siltstone.operators import issues, layout, state, statistics, store, trigrams
from siltstone.plans import analogues as A
from siltstone.plans import made
from siltstone.sources import http_source
from siltstone.streaming import heartbeats, ingest

ZONE, OWNER = "America/Toronto", 3
PAIR = ["user_id", "event_type"]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


@contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """A folder of its own in the shared one, removed at the end."""
    at = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    try:
        yield at
    finally:
        remove(spark, at)


def _schema(kind: StructType, more: str) -> StructType:
    return StructType([*kind.fields, *StructType.fromDDL(more).fields])


# --- sources


@query
def source_refusals(spark, d):
    """The HTTP source's answers to targets that it never asks, from a list with a file for each group of hosts."""
    http_source.register(spark)
    s = A.table(spark, d, "customer").selectExpr("c_custkey AS k").where("k % 8 IN (1, 2, 3, 4, 5)").selectExpr(f"{made._TARGETS} AS url")
    with folder(spark) as at:
        http_source.write_url_list(s, at, 4)
        return cut(spark.read.format("http_pages").option("list", at).option("delayMs", "0").load().select("url", "status", "error"))


# --- streams


def _beats(events: DataFrame) -> DataFrame:
    """Events as heartbeats: a month as two hours."""
    return events.select("user_id", F.timestamp_millis(F.lit(1704067200000) + F.floor((F.unix_millis(F.col("ts").cast("timestamp")) - 1704067200000) / 360).cast("long")).alias("beat"))


def _streamed(spark, d, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that a stream over events gives until it has read them all."""
    own = spark.newSession()  # streams with timers need a setting that other sessions don't
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.shuffle.partitions", str(min(8, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    own.conf.set(*heartbeats.STATE_STORE)
    kind = A.table(spark, d, "events").schema
    with folder(spark) as at:
        stream = found(own.readStream.schema(kind).parquet(f"{d}/events*.parquet"))
        writer = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
        writer.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{at}/out/{n}")).start().awaitTermination()
        return cut(spark.read.schema(stream.schema).parquet(f"{at}/out/*"))


@query
def stale_heartbeats(spark, d):
    """Owners that were silent for more than two minutes, by timers over a stream of heartbeats."""
    found = _streamed(spark, d, lambda e: heartbeats.stale_owners(_beats(e), "user_id", "beat"))
    return found.select("user_id", F.date_format("last_beat", "yyyy-MM-dd HH:mm:ss.SSS").alias("last_beat"), F.date_format("stale_at", "yyyy-MM-dd HH:mm:ss.SSS").alias("stale_at"))


@query
def swept_sessions(spark, d):
    """Sessions of nine hours that events start and renew, by the hourly sweep that finds them over."""
    spans = lambda e: e.select("user_id", "ts", (F.col("ts") + F.expr("INTERVAL 9 HOURS")).alias("expires_at"))
    found = _streamed(spark, d, lambda e: heartbeats.ended_sessions(spans(e), "user_id", "ts", "expires_at"))
    return found.select("user_id", F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss").alias("ended_at"), F.date_format("swept_at", "yyyy-MM-dd HH:mm:ss").alias("swept_at"))


def _ingested(spark, d, at: str) -> tuple[store.Store, store.Store]:
    """Stores of snapshots and latest positions after three replays of the captures, which arrive up to 16 hours late."""
    pair, held = A.pairs(spark, d), "captured_at timestamp, position int"
    kind = pair.schema
    daily = store.Store(spark, f"{at}/daily", tuple(PAIR), _schema(kind, f"snapshot_date date, {held}"), 16)
    latest = store.Store(spark, f"{at}/latest", tuple(PAIR), _schema(kind, held), 16)
    shots = A.snapshots(spark, d).withColumn("day", F.datediff((F.col("captured_at") + F.make_dt_interval(hours=F.col("event_id") % 5 * 4)).cast("date"), F.lit("2024-01-01").cast("date")))
    slices = [shots.where("day < 10"), shots.where("day >= 10 AND day < 20"), shots.where("day >= 20")]
    for rows in [*slices, shots, shots]:  # each slice as it arrives; then all of them again, twice
        rows.drop("day").write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(shots.drop("day").schema).parquet(f"{at}/in")
        ingest.ingest(stream, pair, daily, f"{at}/state", latest).trigger(availableNow=True).start().awaitTermination()
    return daily, latest


@query
def ingested_snapshots(spark, d):
    """One capture a pair and day, after a stream has read all captures three times."""
    with folder(spark) as at:
        found = _ingested(spark, d, at)[0].read()
        return cut(found.select(*PAIR, "snapshot_date", dates.iso_utc(F.col("captured_at")).alias("captured_at"), "position"))


@query
def ingested_latest(spark, d):
    """The latest position of each pair, kept up by the same stream."""
    with folder(spark) as at:
        found = _ingested(spark, d, at)[1].read()
        return cut(found.select(*PAIR, "position", dates.local_day(F.col("captured_at"), ZONE).alias("date")))


# --- stored tables


@query
def rank_latest_kept(spark, d):
    """The latest positions, merged batch by batch: four batches by key, in any order, one of them twice."""
    shots = A.snapshots(spark, d)
    with folder(spark) as at:
        held = store.Store(spark, at, tuple(PAIR), _schema(A.pairs(spark, d).schema, "captured_at timestamp, position int"), 16)
        for part in (2, 0, 3, 1, 2):
            store.keep_latest(held, shots.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == part))
        return cut(held.read().select(*PAIR, "position", dates.local_day(F.col("captured_at"), ZONE).alias("date")))


@query
def stored_page_upserts(spark, d):
    """Pages upserted in place, by URL: first all known ones, then a change that has known and new ones."""
    o = A.table(spark, d, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("url"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("title"))
    new = o.where("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("url"), (-F.col("o_orderkey")).alias("id"), F.lit("X").alias("status"))
    with folder(spark) as at:
        pages = store.Store(spark, at, ("url",), old.schema, 16)
        pages.apply(lambda held, rows: held.unionByName(rows), old)
        pages.apply(lambda held, rows: state.upsert(held, rows, ["url"]), new)
        return cut(pages.read())


@query
def stored_issue_replacement(spark, d):
    """Issues replaced in place, by page."""
    old = A.read_tables(spark, d).seo_issues.select("page_id", "code", "severity")
    done = A.table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("page_id"))
    new = done.select("page_id", F.lit("http_error").alias("code"), F.lit("error").alias("severity"))
    with folder(spark) as at:
        found = store.Store(spark, at, ("page_id",), old.schema, 16)
        found.apply(lambda held, rows: held.unionByName(rows), old)
        found.apply(state.replace_issues, new, done)
        return cut(found.read())


@query
def stored_keyword_sets(spark, d):
    """Keyword sets replaced in place, by page; pairs that survive keep their id."""
    from siltstone.plans.catalog import _pairs_version

    old = _pairs_version(spark, d, 0).withColumn("id", F.col("page_id") * 1000000 + F.col("keyword_id"))
    analysed = A.table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("page_id"))
    with folder(spark) as at:
        sets = store.Store(spark, at, ("page_id",), old.schema, 16)
        sets.apply(lambda held, rows: held.unionByName(rows), old)
        sets.apply(state.replace_keyword_set, _pairs_version(spark, d, 1), analysed)
        return cut(sets.read().select("page_id", "keyword_id", "id", "score"))


@query
def snapshot_statistics(spark, d):
    """What the catalog knows of a stored table of captures after a load: rows, nulls, bounds, and distinct values as an estimate."""
    shots = A.snapshots(spark, d).select("user_id", "event_type", "position", F.to_date("captured_at").alias("snapshot_date"))
    name = f"stored_{uuid.uuid4().hex}"
    with folder(spark) as at:
        try:
            shots.write.option("path", at).saveAsTable(name)
            statistics.refresh(spark, name)
            counted = spark.table(name).agg(*[F.count_distinct(c).alias(c) for c in shots.columns]).unpivot([], shots.columns, "column", "counted")
            found = statistics.column_statistics(spark, name).join(counted, "column")
            close = F.abs(F.col("distinct_values") - F.col("counted")) <= 0.15 * F.col("counted")  # three times the estimate's error
            return cut(found.select("column", "rows", "nulls", "counted", close.alias("close"), "least", "greatest"))
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


# --- lists by layout and index


def load_list_layout(spark: SparkSession, d: str) -> str:
    """The name of the list's layout for a folder of tables, written on the first call of a session."""
    held = _LAYOUTS.setdefault(spark.sparkContext.applicationId, {})
    if d not in held or not spark.catalog.tableExists(f"{held[d]}_pages"):
        name = f"list_{uuid.uuid4().hex}"
        layout.write_layout(A.read_tables(spark, d), name, f"{shared_dir(spark).rstrip('/')}/{name}")
        held[d] = name
    return held[d]


_LAYOUTS: dict[str, dict[str, str]] = {}


def _shown(found: DataFrame) -> DataFrame:
    keys = F.array_join(F.transform("keywords", lambda k: F.concat_ws(":", k["id"].cast("string"), k["term"], F.coalesce(k["position"].cast("string"), F.lit("-")), F.coalesce(k["date"], F.lit("-")))), ";")
    return found.select("id", "url", "title", "fetch_status", "client_id", "client_name", "issue_count", "error_count", F.coalesce(keys, F.lit("")).alias("keywords"), F.col("best_position").cast("long").alias("best_position"))


@query
def pages_list_stored(spark, d):
    """The first page of an owner's list from its layout, which stays for the session."""
    return _shown(layout.list_pages(spark, load_list_layout(spark, d), OWNER, ZONE))


@query
def pages_page_n_stored(spark, d):
    return _shown(layout.list_pages(spark, load_list_layout(spark, d), OWNER, ZONE, page=3, page_size=50))


@query
def pages_search_stored(spark, d):
    return _shown(layout.list_pages(spark, load_list_layout(spark, d), OWNER, ZONE, q="Red Bolt", page_size=100))


#: Signs that mean something to other searches, cases, short ones, long ones, ones that nothing holds.
SEARCHES = ("URGENT", "red bolt", "%", "_", "5%25", "100% c", "1-", "Ab", "0", "https://shop.example/1-urgent/1", "%_", "zzzz", "no such thing anywhere")


@query
def pages_search_indexed(spark, d):
    """A searched list, by postings of trigrams."""
    t = A.read_tables(spark, d)
    with folder(spark) as at:
        return cut(_shown(trigrams.list_pages(t, trigrams.index_pages(t, at), OWNER, ZONE, " URGENT ", page_size=100)))


@query
def indexed_searches(spark, d):
    """All pages of an owner that hold each of several searches, by postings of trigrams."""
    t = A.with_signs(A.read_tables(spark, d))
    with folder(spark) as at:
        index = trigrams.index_pages(t, at)
        found = [trigrams.matching_pages(t, index, OWNER, None, q).select(F.lit(q).alias("q"), "id") for q in SEARCHES]
        return cut(reduce(DataFrame.unionByName, found))


# --- further rules


@query
def further_rules(spark, d):
    """All rules but one, and three of a user's own, in one pass over made pages."""
    c = F.col
    more = [
        issues.Rule("few_headings", "notice", (F.size("headings") < 2) & (c("word_count") > 300), F.format_string("%d headings for %d words", F.size("headings"), c("word_count")), F.struct(c("word_count").alias("words"))),
        issues.Rule("no_site_name", "warning", ~F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("shop")), "Title doesn't name the shop"),
        issues.Rule("thin_content", "error", c("word_count") < 100, F.format_string("Fewer than 100 words: %d", c("word_count"))),
    ]
    return issues.find_issues(made._made_facts(spark, d), more=more, without=["thin_content"]).select("page_id", "code", "severity", "message", "details")

"""A layout for page lists: tables written so that a list reads few files and moves no pairs.

Two stored tables of the catalog, each sorted as it is read:

* <name>_pages (user_id, client_name, client_id, sitemap_position, id, url, title, fetch_status, issue_count, error_count):
  dealt by ranges in the order of the list, so an owner's pages lie together, in several files if there are many;
* <name>_pairs (page_id, keywords, best_position): a row a page, bucketed by page; the keywords in their order, each with
  its term and the instant and position of its latest capture.

A page of a list is a sorted read of its owner's rows; the pairs of its pages, at most MAX_PAGE_SIZE, come from the buckets
of their ids alone. Captures are reduced to the latest of a pair when the layout is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.constants import PAGE_SIZE
from siltstone.functions.dates import local_day
from siltstone.operators.ranks import _place
from siltstone.operators.reads import ORDER, Tables, checked_paging

BUCKETS = 32


def write_layout(t: Tables, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Writes the layout of the tables; one of that name is replaced."""
    spark = t.pages.sparkSession
    counts = t.seo_issues.groupBy(F.col("page_id").alias("id")).agg(F.count(F.lit(1)).alias("issue_count"), F.count_if(F.col("severity") == "error").alias("error_count"))
    owners = t.clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"), "user_id")
    pages = t.pages.join(owners, "client_id").join(counts, "id", "left").fillna(0, ["issue_count", "error_count"])
    pages = pages.select("user_id", *ORDER, "url", "title", "fetch_status", "issue_count", "error_count")
    last = F.max_by(F.struct("captured_at", "position"), F.struct("captured_at", -_place(F.col("position"))))
    latest = t.rank_snapshots.groupBy("page_keyword_id").agg(last.alias("l")).select("page_keyword_id", "l.captured_at", "l.position")
    pairs = t.page_keywords.withColumnRenamed("id", "page_keyword_id").join(t.keywords.select(F.col("id").alias("keyword_id"), "term"), "keyword_id").join(latest, "page_keyword_id", "left")
    rows = F.array_sort(F.collect_list(F.struct("rank_order", "page_keyword_id", F.struct(F.col("keyword_id").alias("id"), "term", "position", "captured_at").alias("k"))))
    pairs = pairs.groupBy("page_id").agg(F.transform(rows, lambda r: r["k"]).alias("keywords"), F.min("position").alias("best_position")).repartition(buckets, "page_id")
    pages.repartitionByRange("user_id", *ORDER).sortWithinPartitions("user_id", *ORDER).write.mode("overwrite").option("path", f"{path}/{name}_pages").saveAsTable(f"{name}_pages")
    pairs.write.mode("overwrite").bucketBy(buckets, "page_id").sortBy("page_id").option("path", f"{path}/{name}_pairs").saveAsTable(f"{name}_pairs")
    for part in ("pages", "pairs"):
        spark.sql(f"ANALYZE TABLE {name}_{part} COMPUTE STATISTICS")


def drop_layout(spark: SparkSession, name: str) -> None:
    for part in ("pages", "pairs"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")


def list_pages(spark: SparkSession, name: str, user, zone: str, client=None, q: str | None = None, page: int = 1, page_size: int = PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """One page of a user's list from the layout; the rows of reads.list_pages.

    Past the end there are no rows. The page's rows, at most MAX_PAGE_SIZE, are read first; their ids prune the buckets.
    """
    q = checked_paging(page, page_size, q)
    pages, pairs = spark.table(f"{name}_pages"), spark.table(f"{name}_pairs")
    rows = pages.where(F.col("user_id") == user)
    if client is not None:
        rows = rows.where(F.col("client_id") == client)
    if q is not None:
        holds = lambda c: F.contains(F.lower(c), F.lit(q.lower()))
        hit = pairs.where(F.exists("keywords", lambda k: holds(k["term"]))).select(F.col("page_id").alias("id"), F.lit(True).alias("_hit"))
        rows = rows.join(hit, "id", "left").where(holds("url") | F.col("_hit").isNotNull()).drop("_hit")
    if after is not None:
        rows = rows.where(F.struct(*ORDER) > F.struct(*[F.lit(x).cast(rows.schema[c].dataType).alias(c) for c, x in zip(ORDER, after, strict=True)]))
    shown = rows.select("id", "url", "title", "fetch_status", "client_id", "client_name", "sitemap_position", "issue_count", "error_count").orderBy(*ORDER).offset((page - 1) * page_size).limit(page_size)
    found = shown.collect()  # at most MAX_PAGE_SIZE rows
    own = pairs.where(F.col("page_id").isin([r.id for r in found]) if found else F.lit(False))
    dated = F.transform("keywords", lambda k: F.struct(k["id"].alias("id"), k["term"].alias("term"), k["position"].alias("position"), local_day(k["captured_at"], zone).alias("date")))
    lists = F.broadcast(own.select(F.col("page_id").alias("id"), dated.alias("keywords"), "best_position"))  # a row a page of the list
    whole = spark.createDataFrame(found, shown.schema).coalesce(1).join(lists, "id", "left").sortWithinPartitions(*ORDER)
    return whole.select("id", "url", "title", "fetch_status", "client_id", "client_name", "issue_count", "error_count", "keywords", "best_position")

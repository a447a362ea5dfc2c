"""The site-analytics relations as they are derived from the benchmark tables.

owner: nation; client: customer; page: order (position by date); pair and issue: line item; term: part name; snapshot:
event of a (user, type) pair, with its value as position; web page: pages, by site key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.lineage import cut
from siltstone.functions.urls import host, site_key
from siltstone.operators.reads import Tables
from siltstone.sources.html import page_facts


#: Tables whose rows are texts: heavy work a row.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Texts in fewer partitions than there are cores, as one small file gives, are dealt over the cores."""
    found, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if name in TEXTS and found.rdd.getNumPartitions() < cores else found


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_snapshots(table(spark, sf_dir, "events"))


def as_snapshots(e: DataFrame) -> DataFrame:
    """(user_id, event_type, event_id, captured_at, position) of events, a stream or a table: about 5 % without a position."""
    position = F.when(F.col("value") >= 147.35, None).otherwise(F.least(F.lit(100), F.lit(1) + F.floor(F.col("value") * 2 / 3)).cast("int"))
    return e.select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("captured_at"), position.alias("position"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type").distinct()


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.withColumn("site", site_key(host(F.col("url"))))


def page_facts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the web pages by the complete parser."""
    return page_facts(table(spark, sf_dir, "pages"))


def site_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the web pages by the complete parser, with their site; parsed once, whatever is asked of them."""
    return cut(page_facts(table(spark, sf_dir, "pages")).withColumn("site", site_key(host(F.col("url")))))


def read_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The relations of the read queries. Line items stand for pairs and, those returned or open, for issues."""
    c, o, li, p = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "part"))
    clients = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("user_id"), F.col("c_name").alias("name"), F.lit(None).cast("timestamp").alias("created_at"))
    pages = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("client_id"), F.concat(F.lit("https://shop.example/"), F.lower("o_orderpriority"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("fetch_status"), F.unix_date(F.to_date("o_orderdate")).alias("sitemap_position"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"))
    terms = p.groupBy(F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("id"))
    named = li.join(p.select("p_partkey", F.col("p_name").alias("term")), li.l_partkey == p.p_partkey).join(terms.withColumnRenamed("id", "keyword_id"), "term")
    pair = named.groupBy(F.col("l_orderkey").alias("page_id"), "keyword_id").agg(F.min("l_linenumber").alias("rank_order"), F.max("l_quantity").alias("score"), F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey"))["l_suppkey"].alias("s"))
    pair = pair.select((F.col("page_id") * 1000000 + F.col("keyword_id")).alias("id"), "page_id", "keyword_id", "rank_order", "score", F.array(F.lit("body")).alias("sources"))
    issues = li.where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("page_id"), F.concat(F.col("l_returnflag"), F.col("l_linenumber").cast("string")).alias("code")).agg(F.when(F.max("l_returnflag") == "R", "error").otherwise("warning").alias("severity"))
    issues = issues.select("page_id", "code", "severity", F.col("code").alias("message"), F.lit(None).cast("string").alias("details"))
    shots = li.join(p.select("p_partkey", F.col("p_name").alias("term")), li.l_partkey == p.p_partkey).join(terms.withColumnRenamed("id", "keyword_id"), "term")
    shots = shots.groupBy((F.col("l_orderkey") * 1000000 + F.col("keyword_id")).alias("page_keyword_id"), F.to_date("l_shipdate").alias("snapshot_date")).agg(F.max(F.col("l_shipdate").cast("timestamp")).alias("captured_at"), F.min(F.when(F.col("l_quantity") < 45, F.col("l_quantity").cast("int"))).alias("position"))
    return Tables(clients, pages, pair, terms.select("id", "term"), issues, shots)


def with_signs(t: Tables) -> Tables:
    """The read relations with per cent signs and underscores in some URLs and terms."""
    url = F.when(F.col("id") % 11 == 0, F.concat("url", F.lit("?off=5%25"))).when(F.col("id") % 7 == 0, F.concat("url", F.lit("_A"))).otherwise(F.col("url"))
    term = F.when(F.col("id") % 9 == 0, F.concat("term", F.lit(" 100% Cotton"))).otherwise(F.col("term"))
    return Tables(t.clients, t.pages.withColumn("url", url), t.page_keywords, t.keywords.withColumn("term", term), t.seo_issues, t.rank_snapshots)

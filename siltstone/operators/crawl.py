"""A crawl's analysis: from the posts of sites and the answers to their URLs to pages, picks, issues and outcomes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.lineage import cut
from siltstone.functions.net import decode_body
from siltstone.functions.text import crawl_error_text
from siltstone.operators.issues import fetch_failure_issues, find_issues
from siltstone.operators.keywords import keyword_picks
from siltstone.operators.state import consecutive_blocks, crawl_outcome, fetch_outcome
from siltstone.sources.html import page_facts


#: Refusals in a row after which a site is left alone.
MAX_BLOCKS = 3


@dataclass
class Crawl:
    pages: DataFrame
    picks: DataFrame
    issues: DataFrame
    outcomes: DataFrame


def analyse_crawl(entries: DataFrame, answers: DataFrame) -> Crawl:
    """pages, picks, issues and outcomes of entries(page_id, site, url, position, allowed) with answers(url, ...).

    Entries that robots.txt forbids are skipped and have no issues; after three refusals in a row the rest of a site is
    blocked. Pages of a site are judged together: title repeats, brands and rarity are of the pages that were analysed.
    """
    rows = entries.join(answers, "url", "left")
    outcome = F.when(~F.col("allowed"), "skipped_robots").when(F.col("error").isNotNull() | F.col("status").isNull(), "failed").otherwise(fetch_outcome(F.col("status"), F.col("content_type"), F.col("mitigated")))
    rows = rows.withColumn("fetch_status", outcome)
    asked = consecutive_blocks(rows.where("allowed"), "site", ["position"], F.col("fetch_status") == "blocked").withColumn("fetch_status", F.when(F.col("stopped"), "blocked").otherwise(F.col("fetch_status")))
    rows = cut(asked.unionByName(rows.where("not allowed").withColumns({"run": F.lit(0).cast("long"), "stopped": F.lit(False)})))
    html = rows.where("fetch_status = 'ok'").select("page_id", "site", F.coalesce("final_url", "url").alias("url"), decode_body(F.col("body"), F.col("content_type")).alias("html"), "x_robots")
    facts = page_facts(html).join(html.select("page_id", "site"), "page_id")
    facts = cut(facts)
    not_html = (F.col("fetch_status") == "failed") & F.col("error").isNull() & (F.col("status") < 400)
    reason = F.when(F.col("stopped"), "blocked by the site").when(F.col("error").isNotNull(), F.col("error")).when(not_html, F.concat(F.lit("Not an HTML page ("), F.coalesce(F.nullif("content_type", F.lit("")), F.lit("no content type")), F.lit(")"))).otherwise("refused")
    failed = rows.where("fetch_status in ('failed', 'blocked')").select("page_id", F.when(~F.col("stopped") & ~not_html, F.col("status")).alias("status"), reason.alias("reason"))
    issues = find_issues(facts).unionByName(fetch_failure_issues(failed))
    pages = rows.join(facts.select("page_id", "title", "meta_description", F.try_element_at("h1s", F.lit(1)).alias("h1"), "word_count", "lang"), "page_id", "left")
    pages = pages.select("page_id", "site", "url", F.col("position").alias("sitemap_position"), "fetch_status", F.col("status").alias("http_status"), "final_url", "title", "meta_description", "h1", "word_count", "lang", F.col("elapsed_ms").alias("response_ms"))
    stopped = rows.groupBy("site").agg(F.max(F.col("run") >= MAX_BLOCKS).alias("stopped"))  # also where nothing came after
    outcomes = crawl_outcome(pages, "site").join(stopped, "site").withColumn("error_code", F.when(F.col("stopped"), "blocked_by_site")).drop("stopped")
    return Crawl(pages, keyword_picks(facts), issues, outcomes)


def crawl_results(discovered: DataFrame, crawl: Crawl) -> DataFrame:
    """(page_id, crawl_status, error_code, message, pages_total, pages_done) of every site of a whole crawl.

    discovered: the rows of discovery.discover_sites, whose posts were crawled as entries of site = their origin. A site
    without posts has failed with its code; the others are done or partial, as their pages came out.
    """
    sites = discovered.groupBy("page_id").agg(F.first("origin", ignorenulls=True).alias("site"), F.first("error_code", ignorenulls=True).alias("code"))
    ends = crawl.outcomes.select("site", "status", F.col("error_code").alias("late"), "message", "total", "analysed")
    failed = F.col("code").isNotNull()
    none = F.lit(0).cast("long")
    return sites.join(ends, "site", "left").select(
        "page_id",
        F.when(failed, "failed").otherwise(F.col("status")).alias("crawl_status"),
        F.coalesce("code", "late").alias("error_code"),
        F.when(failed, crawl_error_text(F.col("code"))).otherwise(F.col("message")).alias("message"),
        F.coalesce("total", none).alias("pages_total"),
        F.coalesce("analysed", none).alias("pages_done"),
    )


def rows_from_arrays(arrays: DataFrame, *columns: str) -> DataFrame:
    """The rows that come as equally long arrays, one a column, zipped: the shape of a bulk load. Other columns are repeated."""
    rest = [c for c in arrays.columns if c not in columns]
    return arrays.select(*rest, F.inline(F.arrays_zip(*columns)))


def is_alive(spark: SparkSession) -> bool:
    """A health probe."""
    return spark.range(1).count() == 1


def health(spark: SparkSession, read: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(relation, ok, rows): whether each relation can be read, and how many rows it has; a row a relation.

    What can't be read is not ok and has no rows; its cause is left to the log.
    """
    found = []
    for name, relation in read.items():
        try:
            found.append((name, True, relation().count()))
        except Exception:  # whatever it is, the relation isn't available
            found.append((name, False, None))
    return spark.createDataFrame(found, "relation string, ok boolean, rows long")

"""python -m siltstone.report SF_DIR [SITE]: what discovery finds for the sites of a data set, for one of them or for all."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import crawl_error_text
from siltstone.session import local_session

SHOWN_SITEMAPS = 3


def lines(found: DataFrame) -> DataFrame:
    """(page_id, line, text): a report of each site of found, the rows of discovery.discover_sites, line by line.

    Site, hub, the first sitemaps, pause and posts in their order, those that robots.txt forbids marked; or why there are
    none.
    """
    one = lambda c: F.first(c, ignorenulls=True).alias(c)
    posts = F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("post", "url", "allowed")))).alias("posts")
    sites = found.groupBy("page_id", "entered_url").agg(one("origin"), one("hub_url"), one("members"), one("crawl_delay"), one("error_code"), posts)
    more = F.size("members") - SHOWN_SITEMAPS
    maps = F.concat(F.array_join(F.slice("members", 1, SHOWN_SITEMAPS), ", "), F.when(more > 0, F.format_string(" and %d more", more)).otherwise(""))
    listed = F.transform("posts", lambda p: F.concat(F.format_string("%3d  %s", p["post"], p["url"]), F.when(p["allowed"], "").otherwise("  (forbidden by robots.txt)")))
    delay = F.coalesce(F.concat(F.col("crawl_delay").cast("string"), F.lit(" s")), F.lit("none"))
    said = F.concat(
        F.array(F.concat(F.lit("site: "), F.col("origin")), F.concat(F.lit("hub: "), F.coalesce("hub_url", F.lit("none linked"))), F.concat(F.lit("sitemaps: "), maps), F.concat(F.lit("pause: "), delay), F.format_string("posts: %d", F.size("posts"))),
        listed,
    )
    failed = F.array(F.concat(F.lit("site: "), F.col("entered_url")), F.concat(F.lit("nothing found ("), F.col("error_code"), F.lit("): "), crawl_error_text(F.col("error_code"))))
    return sites.select("page_id", F.posexplode(F.when(F.col("error_code").isNull(), said).otherwise(failed)).alias("line", "text"))


def main(args: list[str]) -> int:
    from siltstone.operators.discovery import discover_sites
    from siltstone.plans.made import made_sites

    if not 1 <= len(args) <= 2:
        print(__doc__)
        return 2
    home, robots, documents = made_sites(local_session(), args[0])
    if args[1:]:
        home = home.where(F.contains("entered_url", F.lit(args[1])))
    found = lines(discover_sites(home, robots, documents, "ExampleBot")).orderBy("page_id", "line").toLocalIterator()
    shown = [print(r.text) for r in found]
    if not shown:
        print("no such site")
    return 0 if shown else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

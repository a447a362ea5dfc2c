"""The page rules: each is a condition, a message and details over a page's facts and its site's title counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.constants import LISTED_IMAGES, RENDERED_WORDS, SEARCH_AGENTS, THIN_WORDS, TITLE_MAX, TITLE_MIN, VALUE_DIRECTIVES
from siltstone.functions.text import utf16_length
from siltstone.functions.urls import resolve_any, strip_hash


SEVERITIES = ("error", "warning", "notice")


@dataclass(frozen=True)
class Rule:
    """A rule: whether a page breaks it, what is said then, and details as a struct.

    Conditions, messages and details are over the columns of page_facts, those that the facts have besides, the site
    and title_count, and are computed in the one pass over the facts with all other rules. A null condition is none.
    """

    code: str
    severity: str
    when: Column
    message: Column | str
    details: Column | None = None

    def __post_init__(self):
        if not self.code or self.severity not in SEVERITIES:
            raise ValueError(f"a rule has a code and one of the severities {', '.join(SEVERITIES)}")

    def issue(self) -> Column:
        return _issue(self.code, self.severity, self.when, self.message, self.details)


def blocks_indexing(robots: Column) -> Column:
    """Whether comma-separated robots directives keep search engines out, those for other agents apart."""

    def one(part: Column) -> Column:
        directive = F.trim(part)
        agent = F.trim(F.regexp_extract(directive, r"^([\w-]+)\s*:\s*(.+)$", 1))
        scoped = (agent != "") & ~agent.isin(VALUE_DIRECTIVES)
        value = F.when(scoped, F.trim(F.regexp_extract(directive, r"^([\w-]+)\s*:\s*(.+)$", 2))).otherwise(directive)
        return (~scoped | agent.isin(SEARCH_AGENTS)) & value.isin("noindex", "none")

    return F.coalesce(F.exists(F.split(F.lower(robots), ","), one), F.lit(False))


def _issue(code: str, severity: str, when: Column, message: Column | str, details: Column | None = None) -> Column:
    message = message if isinstance(message, Column) else F.lit(message)
    details = F.to_json(details) if details is not None else F.lit(None).cast("string")
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), details.alias("details")))


def rules(resolved_canonical: bool = True) -> list[Column]:
    """A nullable struct<code, severity, message, details> for every rule, over page_facts columns and title_count.

    resolved_canonical: resolve relative canonical URLs (Python); otherwise they are taken as absolute.
    """
    c = F.col
    title, size, words = c("title"), F.coalesce(utf16_length(c("title")), F.lit(0)), c("word_count")
    canonical = strip_hash(resolve_any(c("canonical"), c("url"))) if resolved_canonical else strip_hash(c("canonical"))
    h1s, missing = F.size("h1s"), F.size("images_missing_alt")
    s = lambda **cols: F.struct(*[v.alias(k) for k, v in cols.items()])
    # Codes, severities and messages.
    return [
        _issue("noindex", "error", blocks_indexing(c("robots")), "Page asks search engines not to index it", s(robots=c("robots"))),
        _issue("title_missing", "error", title.isNull(), "Page has no <title>"),
        _issue("title_length", "warning", title.isNotNull() & ~size.between(TITLE_MIN, TITLE_MAX), F.format_string(f"Title is %d characters; {TITLE_MIN}–{TITLE_MAX} usually displays best", size), s(length=size)),
        _issue("title_duplicate", "warning", title.isNotNull() & (c("title_count") > 1), F.format_string("%d crawled pages share this title", c("title_count")), s(title=title)),
        _issue("meta_description_missing", "warning", c("meta_description").isNull(), "Page has no meta description"),
        _issue("h1_missing", "error", h1s == 0, "Page has no H1 heading"),
        _issue("h1_multiple", "warning", h1s > 1, F.format_string("Page has %d H1 headings", h1s), s(h1s=c("h1s"))),
        _issue("canonical_missing", "warning", c("canonical").isNull(), "Page has no canonical URL"),
        _issue("canonical_mismatch", "warning", canonical.isNotNull() & (canonical != strip_hash(c("url"))), "Canonical URL points to a different page", s(canonical=canonical)),
        _issue("thin_content", "warning", (words >= RENDERED_WORDS) & (words < THIN_WORDS), F.format_string("Only %d words of main content", words), s(words=words)),
        _issue("client_rendered", "warning", (words < RENDERED_WORDS) & (c("script_count") > 0), "Almost no text in the HTML: content is likely rendered by JavaScript, which crawlers may not see", s(words=words, scripts=c("script_count"))),
        _issue("images_missing_alt", "warning", missing > 0, F.format_string("%d of %d images have no alt text", missing, c("images_total")), s(images=F.slice("images_missing_alt", 1, LISTED_IMAGES))),
        _issue("mixed_content", "warning", c("insecure_resources") > 0, F.format_string("%d resources load over plain http", c("insecure_resources")), s(count=c("insecure_resources"))),
    ]


#: The codes of the rules that are always there, in their order.
CODES = ("noindex", "title_missing", "title_length", "title_duplicate", "meta_description_missing", "h1_missing", "h1_multiple", "canonical_missing", "canonical_mismatch", "thin_content", "client_rendered", "images_missing_alt", "mixed_content")


def find_issues(facts: DataFrame, site_col: str = "site", resolved_canonical: bool = True, more: Sequence[Rule] = (), without: Sequence[str] = ()) -> DataFrame:
    """(page_id, code, severity, message, details): the issues of page facts with a site column, in one pass.

    more: further rules, after the others; without: codes of rules that are left out. A code stands for one rule: a
    further rule may take the place of one that is left out, but not of one that isn't.

    A title is a duplicate if pages of its site share it exactly. Titles are counted apart and joined back, so that a
    site of any size has no window of its own.
    """
    unknown = [c for c in without if c not in CODES]
    codes = [c for c in CODES if c not in without] + [r.code for r in more]
    if unknown or len(set(codes)) < len(codes):
        raise ValueError(f"unknown rules {unknown}" if unknown else "a code stands for one rule")
    chosen = [rule for code, rule in zip(CODES, rules(resolved_canonical), strict=True) if code not in without] + [r.issue() for r in more]
    counts = facts.where("title is not null").groupBy(F.col(site_col).alias("_site"), F.col("title").alias("_title")).agg(F.count(F.lit(1)).alias("title_count"))
    both = facts.join(counts, (F.col(site_col) == F.col("_site")) & (F.col("title") == F.col("_title")), "left").withColumn("title_count", F.coalesce("title_count", F.lit(0)))
    return both.select("page_id", F.inline(F.filter(F.array(*chosen), lambda i: i.isNotNull())))


def fetch_failure_issues(failures: DataFrame) -> DataFrame:
    """The issue of every row of failures(page_id, status, reason): a page of the sitemap that was not fetched."""
    message = F.when(F.col("status").isNotNull() & (F.col("status") != 0), F.format_string("URL listed in the sitemap returns HTTP %d", F.col("status"))).otherwise(F.concat(F.lit("URL listed in the sitemap could not be fetched: "), F.coalesce("reason", F.lit(""))))
    details = F.when(F.col("status").isNotNull() & (F.col("status") != 0), F.to_json(F.struct("status")))
    return failures.select("page_id", F.lit("http_error").alias("code"), F.lit("error").alias("severity"), message.alias("message"), details.alias("details"))


def issue_counts(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """(page_id, issue_count, error_count) of every page."""
    n = issues.groupBy("page_id").agg(F.count(F.lit(1)).alias("issue_count"), F.count_if(F.col("severity") == "error").alias("error_count"))
    return facts.select("page_id").join(n, "page_id", "left").select("page_id", F.coalesce("issue_count", F.lit(0)).alias("issue_count"), F.coalesce("error_count", F.lit(0)).alias("error_count"))


def with_title_count(facts: DataFrame, site_col: str = "site") -> DataFrame:
    """Facts with how many pages of the site have the same title, for sites that fit a window."""
    return facts.withColumn("title_count", F.count("title").over(Window.partitionBy(site_col, "title")))

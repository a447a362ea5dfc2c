"""Literal search by trigram postings: the rarest trigrams of a search name the few texts that may hold it.

build writes three tables: postings (gram, id), a row for each text and each of its distinct trigrams, sorted by gram over
all files, so that a gram's ids are a few row groups; sizes (gram, n); and texts (id, text), sorted by id. A search looks its
grams up in sizes (a row a gram of the search), intersects the postings of the rarest, and compares the texts of the ids that
are left, which are read by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.constants import MAX_QUERY, PAGE_SIZE
from siltstone.functions.lineage import remove
from siltstone.operators import reads
from siltstone.operators.reads import Tables, checked_paging

GRAM = 3
#: Postings that are intersected, at most: further ones cost more than they rule out.
RAREST = 4
#: Ids that are looked up one by one, at most; more of them are joined.
FEW = 1000


def grams(value: Column) -> Column:
    """The distinct trigrams of a text in lower case; a shorter text is a gram of its own."""
    low = F.lower(value)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(low) - (GRAM - 1))), lambda i: F.substr(low, i, F.lit(GRAM))))


@dataclass
class Index:
    """Where an index lies."""

    spark: SparkSession
    path: str

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def sizes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sizes")

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def remove(self) -> None:
        remove(self.spark, self.path)


def build(texts: DataFrame, path: str) -> Index:
    """Writes the index of texts(id, text). Null texts aren't in it; an id may have several texts."""
    index = Index(texts.sparkSession, path)
    texts.where("text is not null").select("id", "text").distinct().repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/texts")
    rows = index.texts().select(F.explode(grams(F.col("text"))).alias("gram"), "id").distinct()
    rows.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{path}/postings")
    index.postings().groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/sizes")
    return index


def candidates(index: Index, q: str) -> DataFrame:
    """(id) of all texts that may hold q, and of few others."""
    low = q.lower()
    if not low:
        return index.postings().select("id").distinct()
    if len(low) < GRAM:  # a text that holds it has a gram that does
        near = index.sizes().where(F.contains("gram", F.lit(low))).select("gram")
        return index.postings().join(near, "gram", "left_semi").select("id").distinct()
    own = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    known = {r.gram: r.n for r in index.sizes().where(F.col("gram").isin(own)).collect()}  # at most MAX_QUERY rows
    if len(known) < len(own):
        return index.postings().select("id").limit(0)
    rare = sorted(own, key=lambda g: (known[g], g))[:RAREST]
    found = index.postings().where(F.col("gram").isin(rare))
    if len(rare) == 1:
        return found.select("id")
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare)).select("id")


def search(index: Index, q: str) -> DataFrame:
    """(id, text) of the texts that hold q, case apart, literally: what a scan for it would give.

    ValueError for a search that is too long. An empty search is held by every text. Signs that mean something elsewhere,
    as % and _, are signs.
    """
    if len(q) > MAX_QUERY:
        raise ValueError(f"a search has at most {MAX_QUERY} characters")
    ids = candidates(index, q)
    few = ids.limit(FEW + 1).collect()
    texts = index.texts()
    found = texts.where(F.col("id").isin([r.id for r in few]) if few else F.lit(False)) if len(few) <= FEW else texts.join(ids, "id", "left_semi")
    return found.where(F.contains(F.lower("text"), F.lit(q.lower())))


@dataclass
class PageIndex:
    """The indexes of a site list: the URLs of the pages and the terms of the keywords."""

    urls: Index
    terms: Index

    def remove(self) -> None:
        self.urls.remove()
        self.terms.remove()


def index_pages(t: Tables, path: str) -> PageIndex:
    return PageIndex(build(t.pages.select("id", F.col("url").alias("text")), f"{path}/urls"), build(t.keywords.select("id", F.col("term").alias("text")), f"{path}/terms"))


def matching_pages(t: Tables, index: PageIndex, user: str, client: str | None, q: str) -> DataFrame:
    """What reads.matching_pages finds for a search, by postings: pages are joined to the ids that hit."""
    by_url = search(index.urls, q).select("id")
    terms = search(index.terms, q).select(F.col("id").alias("keyword_id"))
    by_term = t.page_keywords.join(terms, "keyword_id", "left_semi").select(F.col("page_id").alias("id"))
    return reads.matching_pages(t, user, client).join(by_url.unionByName(by_term).distinct(), "id", "left_semi")


def list_pages(t: Tables, index: PageIndex, user: str, zone: str, q: str | None, client: str | None = None, page: int = 1, page_size: int = PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """One page of a user's list, searched by postings; the same rows as reads.list_pages."""
    q = checked_paging(page, page_size, q)
    found = reads.matching_pages(t, user, client) if q is None else matching_pages(t, index, user, client, q)
    return reads.listed(t, found, zone, page, page_size, after)

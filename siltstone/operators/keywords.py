"""Phrase picks: phrases scored by placement, frequency and rarity within a site."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions.constants import BODY_ONLY_WEIGHT, INTRO_WORDS, MAX_KEYWORDS, MIN_SCORE, SOURCE_WEIGHTS
from siltstone.functions.lineage import cut
from siltstone.functions.phrases import phrase_array, phrase_lists, places
from siltstone.functions.text import round2, site_name, strip_site_name
from siltstone.functions.urls import slug_text
from siltstone.operators import term_trees


def phrases(df: DataFrame, id_col: str, text_col: str, inner_stopwords: bool = True, compose: bool = True) -> DataFrame:
    """(id, term) with repeats: the phrases of every text."""
    return df.select(id_col, F.explode(phrase_array(F.col(text_col), inner_stopwords, compose)).alias("term"))


#: Texts, and bytes of text, whose phrases are held at a time: a text has some ten times its size in phrases.
HELD_TEXTS, HELD_BYTES = 500, 2_000_000
#: Ids that are looked up by broadcast, and bytes of text of an id that become one value.
FEW_IDS, UNITED_BYTES = 200_000, 1_000_000


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an index of each different key, in their order; how often it is there)."""
    order = np.argsort(key)
    new = np.flatnonzero(np.diff(key[order], prepend=-1))
    return order[new], np.diff(np.append(new, len(key)))


def _numbers(key: np.ndarray) -> np.ndarray:
    """Each key's number among the different ones."""
    order = np.argsort(key)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0) - 1
    return number


def _own_counts(texts: list[str | None], inner: bool, compose: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text, term, n): the different phrases of each text, told apart by the numbers of their words; only what goes out is put together."""
    p = places(texts, compose)
    words, code = np.int64(len(p.known) + 1), p.codes.astype(np.int64)
    one = p.text * words + code
    two = one[:-1] * words + code[1:]
    pair = _numbers(two)
    keys = [one, two, pair[:-1] * words + code[2:], pair[:-2] * np.int64(len(pair) + 1) + pair[2:]]
    text, term, n = [], [], []
    for size, key in enumerate(keys, 1):
        good = p.good(size, inner)
        first, many = _repeats(key[good])
        at = good[first]
        own = [p.known.take(pa.array(p.codes[at + k])) for k in range(size)]
        text.append(p.text[at])
        term.append(own[0] if size == 1 else pc.binary_join_element_wise(*own, " "))
        n.append(many)
    return np.concatenate(text), pa.concat_arrays([x.cast(pa.string()) for x in term]), np.concatenate(n).astype(np.int64)


def _held(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of at most HELD_TEXTS texts and, but for the last one of a run, HELD_BYTES."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(texts):
        held = int(np.searchsorted(size, (size[begin - 1] if begin else 0) + HELD_BYTES)) + 1
        end = min(begin + HELD_TEXTS, held, len(texts))
        yield begin, end
        begin = end


def _counted(batches, name: str, inner: bool, compose: bool):
    """phrase_counts of batches (id, text), HELD_TEXTS and HELD_BYTES at a time."""
    for batch in batches:
        for a, b in _held(batch.column(1)):
            own = batch.slice(a, b - a)
            text, term, n = _own_counts(own.column(1).to_pylist(), inner, compose)
            yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(text)), term, pa.array(n)], names=[name, "term", "n"])


def phrase_counts(df: DataFrame, id_col: str, text_col: str, inner_stopwords: bool = True, compose: bool = True) -> DataFrame:
    """(id, term, n): each text's different phrases and how often it has them; rows with one id are counted each.

    Counted where the text is cut, and handed on a few texts at a time.
    """
    rows = df.select(id_col, text_col)

    def run(batches):
        return _counted(batches, id_col, inner_stopwords, compose)

    return rows.mapInArrow(run, StructType([rows.schema[0], *StructType.fromDDL("term string, n long").fields]))


def phrase_totals(df: DataFrame, id_col: str, text_col: str, inner_stopwords: bool = True, compose: bool = True) -> DataFrame:
    """(id, term, n): each id's different phrases and how often its texts have them; rows with a null id are one id.

    An id with one row is counted where it is read, without a shuffle. Of others the texts are shuffled, not their phrases: an id's texts
    become one value, a border between them, or trees if they have more than UNITED_BYTES. With more than FEW_IDS such ids all texts are.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    size = F.sum(F.octet_length("text") + F.lit(1).cast("long"))
    several = rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), size.alias("bytes")).where("rows > 1")
    several = cut(several.select(F.col("id").alias("of"), (F.col("bytes") > UNITED_BYTES).alias("large")))
    ids, large = several.agg(F.count(F.lit(1)), F.count_if("large")).first()
    few = ids <= FEW_IDS
    found, parts = rows, []
    if ids:
        own = rows.join(F.broadcast(several if few else several.where("large")), F.col("id").eqNullSafe(F.col("of")), "left")
        united = own.where("not large" if few else "large is null").groupBy("id").agg(F.array_join(F.collect_list("text"), "|").alias("text"))
        found = own.where("large is null").select("id", "text").union(united) if few else united
        parts = [term_trees.occurrences(own.where("large"), "id", "text", inner_stopwords, compose)] if large else []
    return reduce(DataFrame.union, parts, phrase_counts(found, "id", "text", inner_stopwords, compose)).withColumnRenamed("id", id_col)


def brand_words(facts: DataFrame, site_col: str = "site", compose: bool = True) -> DataFrame:
    """(site, word): words of the title suffix that at least two pages and half of a site's pages share.

    Of suffixes shared by as many pages the one on the earliest page counts.
    """
    named = facts.select(F.col(site_col).alias("site"), "page_id", site_name(F.col("title")).alias("suffix"))
    n = named.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    counts = named.where("suffix is not null").groupBy("site", "suffix").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    top = counts.groupBy("site").agg(F.max_by(F.struct("suffix", "n"), F.struct(F.col("n"), -F.col("first"))).alias("top"))
    top = top.join(n, "site").where((F.col("top.n") >= 2) & (F.col("top.n") >= F.col("pages") / 2))
    words = top.select("site", F.explode(phrase_array(F.col("top.suffix"), True, compose)).alias("word"))
    return words.where(~F.contains("word", F.lit(" "))).distinct()


def _intro(main_text: Column) -> Column:
    return F.array_join(F.slice(F.split(main_text, r"(?U)\s+"), 1, INTRO_WORDS), " ")


#: Places whose single words count, and places of running text, where phrases have several words and no stopword.
_NAMED, _RUNNING = ["title", "h1", "slug", "schema", "heading"], ["meta", "intro"]
_FOUND = pa.schema([("site", pa.string()), ("page_id", pa.int64()), ("term", pa.string()), ("places", pa.int32()), ("body_count", pa.int64())])


def _page_terms(batch: pa.RecordBatch, compose: bool) -> pa.RecordBatch:
    """_FOUND of a batch of (site, page_id, an array of texts for each place, body); places: a bit for each of SOURCE_WEIGHTS."""
    bits = {name: 1 << i for i, name in enumerate(SOURCE_WEIGHTS)}
    terms, pages, marks = [], [], []
    for places, inner in ((_NAMED, True), ([*_RUNNING, "body"], False)):
        lists = [batch.column(p) for p in places]
        size = [x.value_lengths().fill_null(0).to_numpy() for x in lists]
        found, count = phrase_lists([t for x in lists for t in x.flatten().to_pylist()], inner, compose)
        page = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n in size])
        mark = np.repeat([bits.get(p, 0) for p in places], [n.sum() for n in size])
        page, mark = np.repeat(page, count), np.repeat(mark, count)
        several = pc.match_substring(found, " ").to_numpy(zero_copy_only=False)
        keep = several | ~np.isin(mark, [bits[p] for p in _RUNNING])
        terms.append(found.filter(pa.array(keep)))
        pages.append(page[keep])
        marks.append(mark[keep])
    coded = pa.concat_arrays(terms).dictionary_encode()
    n = max(1, len(coded.dictionary))
    key, at = np.unique(np.concatenate(pages) * n + coded.indices.to_numpy(), return_inverse=True)
    mark, places = np.concatenate(marks), np.zeros(len(key), np.int32)
    np.bitwise_or.at(places, at, mark.astype(np.int32))
    body = np.bincount(at, mark == 0, len(key)).astype(np.int64)
    term = coded.dictionary.take(pa.array(key % n))
    keep = pa.array((places > 0) | pc.match_substring(term, " ").to_numpy(zero_copy_only=False))
    own = pa.array(key // n)
    found = pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), term, pa.array(places), pa.array(body)], schema=_FOUND)
    return found.filter(keep)


def candidates(facts: DataFrame, site_col: str = "site", compose: bool = True) -> DataFrame:
    """(site, page_id, term, sources, body_count) of every phrase that may be picked; facts has a row a page.

    Single words come from chosen places only; in running text (meta, intro, body) phrases have several words and no
    stopword. Body counts single words that have another place. Phrases with a brand word are none. A page's places are
    tokenized and counted in one pass, without a shuffle.
    """
    none = F.array().cast("array<string>")
    texts = {
        "title": F.array(strip_site_name(F.col("title"))),
        "h1": F.col("h1s"),
        "slug": F.array(slug_text(F.col("url"))),
        "schema": F.col("jsonld_keywords"),
        "heading": F.col("headings"),
        "meta": F.array("meta_description"),
        "intro": F.array(_intro(F.col("main_text"))),
        "body": F.array("main_text"),
    }
    base = facts.select(F.col(site_col).cast("string").alias("site"), F.col("page_id").cast("long"), *[F.coalesce(v, none).alias(k) for k, v in texts.items()])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                yield _page_terms(batch.slice(a, 500), compose)

    found = base.mapInArrow(run, "site string, page_id long, term string, places int, body_count long")
    brand = brand_words(facts, site_col, compose).groupBy("site").agg(F.collect_set("word").alias("brand"))
    found = found.join(brand, "site", "left").where(F.col("brand").isNull() | ~F.arrays_overlap(F.split("term", " "), "brand"))
    sources = F.array_compact(F.array(*[F.when(F.col("places").bitwiseAND(1 << i) != 0, name) for i, name in enumerate(SOURCE_WEIGHTS)]))
    return found.select("site", "page_id", "term", sources.alias("sources"), "body_count")


def keyword_scores(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, page_id, term, score, sources) of candidates of enough weight; pages(site) gives each site's page count."""
    found = cut(found)  # texts are tokenized once, for the counts and the rows
    df = found.groupBy("site", "term").agg(F.count(F.lit(1)).alias("df"))
    n = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    rows = found.join(df, ["site", "term"]).join(n, "site")
    weight = F.create_map(*[x for k, v in SOURCE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    place = F.aggregate("sources", F.lit(0.0), lambda total, s: total + F.element_at(weight, s))
    words = F.size(F.split("term", " "))
    bonus = F.when(words.isin(2, 3), 1.3).when(words == 4, 1.1).otherwise(1.0)
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    rows = rows.withColumn("place", place).where((F.col("place") > 0) | (F.col("body_count") >= 3))
    score = (F.col("place") + F.log1p("body_count") * F.when(F.col("place") == 0, BODY_ONLY_WEIGHT).otherwise(1.0)) * bonus * idf
    sources = F.when(F.col("body_count") > 0, F.array_append("sources", F.lit("body"))).otherwise(F.col("sources"))
    return rows.select("site", "page_id", "term", score.alias("score"), sources.alias("sources")).where(F.col("score") >= MIN_SCORE)


def pick(scored: DataFrame) -> DataFrame:
    """(site, page_id, rank_order, term, score, sources): each page's best phrases that don't overlap a better one.

    Best first by unrounded score, ties in dictionary order (ICU); a phrase that contains a kept one, or is within one, goes.
    """
    order = F.struct((-F.col("score")).alias("k"), F.collate("term", "UNICODE").alias("c"), "term", "score", "sources")
    rows = F.array_sort(F.collect_list(order))
    padded = lambda r: F.concat(F.lit(" "), r["term"], F.lit(" "))
    clash = lambda kept, r: F.exists(kept, lambda k: F.contains(padded(k), padded(r)) | F.contains(padded(r), padded(k)))
    empty = F.slice("rows", 1, 0)
    kept = F.aggregate("rows", empty, lambda kept, r: F.when((F.size(kept) >= MAX_KEYWORDS) | clash(kept, r), kept).otherwise(F.array_append(kept, r)))
    found = scored.groupBy("site", "page_id").agg(rows.alias("rows")).select("site", "page_id", F.posexplode(kept).alias("i", "r"))
    return found.select("site", "page_id", (F.col("i") + 1).alias("rank_order"), "r.term", round2(F.col("r.score")).alias("score"), "r.sources")


def keyword_picks(facts: DataFrame, site_col: str = "site", compose: bool = True) -> DataFrame:
    """The picks of page facts with a site column; one row a pick."""
    return pick(keyword_scores(candidates(facts, site_col, compose), facts.select(F.col(site_col).alias("site"))))

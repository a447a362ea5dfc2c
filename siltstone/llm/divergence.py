"""How the sources of a language differ in what they write about: a sorted stream of terms, scanned by runs.

A task turns a block of documents into rows sorted by (lang, term, source, document); the scan of a run counts occurrences
and documents and passes one row a run on. Rows of all blocks are added up, dealt by (lang, term), sorted again, and the
second scan knows of every term in how many documents of its language it is, and of every source what it holds of it.

A term that a source lacks has the same share there as all others that it lacks. So a run gives partial distances only for
the sources that hold its term against the others, and what the terms in no run of a pair add is a product. Sources are
taken in blocks of SOURCES and terms in shards of about ENTRIES rows, so that a task holds a bounded part of a language
however many sources and terms it has. Each shard emits one partial distance a pair.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import arrow_schema, blocks, cut, map_arrow, table

LEAST_DOCUMENTS, SCALE, PRIOR, TOP = 30, 1_000_000_000, 5, 50
#: Bytes of text of a block, and of a piece of a long text.
BLOCK_BYTES, PIECE_BYTES = 16_000_000, 4_000_000
#: Sources of a block; rows of a shard on average; cells of a matrix of terms and sources.
SOURCES, ENTRIES, CELLS = 512, 200_000, 1_000_000
#: Groups that are broadcast, at most: some 100 bytes each.
FEW_GROUPS = 50_000

#: Letters A-Z in lower case, all other ASCII characters as spaces.
_TERMS = bytes(32 if c < 0x41 or 0x5A < c < 0x61 or 0x7A < c < 0x80 else c + 32 if c < 0x5B else c for c in range(256))


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in bounded lists."""
    at, data = 0, data.translate(_TERMS)
    while at < len(data):
        end = data.find(b" ", at + PIECE_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _runs(batches):
    """(lang, term, source, documents, n) of each run of a block's terms, sorted by lang, term, source and document."""
    for block in blocks(batches, BLOCK_BYTES):
        names = list(zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True))
        groups = sorted(set(names))
        number = {g: i for i, g in enumerate(groups)}
        of = np.fromiter(map(number.__getitem__, names), np.int64, len(names))
        rank = np.empty(len(of), np.int64)
        rank[np.argsort(of, kind="stable")] = np.arange(len(of))  # documents by lang and source
        vocabulary: defaultdict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        keys, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for doc, data in zip(rank.tolist(), block.column(2).cast(pa.binary()), strict=True):
            own = [np.unique(np.fromiter(map(vocabulary.__getitem__, terms), np.int64, len(terms)), return_counts=True) for terms in pieces(data.as_py() or b"")]
            if len(own) > 1:  # a document's terms count once in documents, however many pieces it has
                found, at = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True)
                own = [(found, np.bincount(at, np.concatenate([n for _, n in own])).astype(np.int64))]
            for found, n in own:
                keys.append(found << 32 | doc)
                times.append(n)
        key, n = np.concatenate(keys), np.concatenate(times)
        if not len(key):
            continue
        order = np.argsort(key)
        key, n = key[order], n[order]
        term, group = key >> 32, np.sort(of)[key & 0xFFFFFFFF]
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (group[1:] != group[:-1])]))
        lang, source = (pa.array([g[i] for g in groups], pa.string()).take(pa.array(group[first])) for i in (0, 1))
        spelled = pa.array(list(vocabulary), pa.binary()).cast(pa.string()).take(pa.array(term[first]))
        yield [lang, spelled, source, np.diff(np.append(first, len(key))), np.add.reduceat(n, first)]


def _kept(least: int):
    """(lang, term, source, n, lang_n, new) of the terms in at least so many documents; rows come by lang, term and source.

    lang_n: occurrences in the lang; new: 1 in one row of each term.
    """

    def run(batches):
        held = None
        for batch in chain(batches, [None]):
            last = batch is None
            held = batch if held is None else held if last else pa.concat_batches([held, batch])
            if held is None or not held.num_rows:
                continue
            same = [pa.compute.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in (held.column(0), held.column(1))]
            first = np.flatnonzero(np.concatenate([[True], ~(same[0] & same[1])]))
            end = held.num_rows if last else int(first[-1])  # the last run may go on in the next batch
            first = first[first < end]
            if end:
                documents, n = (held.column(i).to_numpy()[:end] for i in (3, 4))
                size = np.diff(np.append(first, end))
                enough = np.repeat(np.add.reduceat(documents, first) >= least, size)
                new = np.zeros(end, np.int64)
                new[first] = 1
                at = np.flatnonzero(enough)
                yield [*(held.column(i).take(pa.array(at)) for i in range(3)), n[at], np.repeat(np.add.reduceat(n, first), size)[at], new[at]]
            held = held.slice(end)

    return run


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact at any size; 0 where there are no terms."""
    wide = lambda x: x.cast("decimal(20,0)")
    whole = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + PRIOR), wide(total + PRIOR * terms))
    return F.when(terms > 0, 1 + whole).otherwise(F.lit(0)).cast("long")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, source, n, lang_n, new) of docs(lang, source, text), all without nulls; see _kept."""
    found = map_arrow(docs.select("lang", "source", "text"), _runs, "lang string, term string, source string, documents long, n long")
    added = found.groupBy("lang", "term", "source").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"))
    return map_arrow(added.repartition("lang", "term").sortWithinPartitions("lang", "term", "source"), _kept(least), "lang string, term string, source string, n long, lang_n long, new long")


def _groups(docs: DataFrame, kept: DataFrame, sources: int, entries: int) -> DataFrame:
    """Every (lang, source) with its number in the lang, block, blocks and shards of the lang, totals and absent share."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("new").alias("terms"), F.count(F.lit(1)).alias("rows"))
    every = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    of_lang = Window.partitionBy("lang")  # a row a source
    every = every.withColumn("number", F.row_number().over(of_lang.orderBy("source")) - 1).withColumn("sources", F.count(F.lit(1)).over(of_lang))
    return every.select(
        "lang", "source", "number", "total", "lang_total", "terms",
        F.floor(F.col("number") / sources).cast("int").alias("block"),
        F.ceil(F.col("sources") / sources).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / entries)).cast("int").alias("shards"),
        share(F.lit(0), F.col("total"), F.col("terms")).alias("absent"),
    )


_DISTANCES = "lang string, a string, b string, value long"


def _distances(sources: int):
    """Partial distances of the pairs of two blocks of sources over a shard of the terms.

    Rows without a term are the sources themselves, with the share of terms that they lack; the others are terms they have.
    """

    def solve(rows: pa.Table) -> pa.Table:
        low, high, shard = (rows.column(c)[0].as_py() for c in ("low", "high", "shard"))
        block, place, value = (rows.column(c).to_numpy() for c in ("block", "number", "value"))
        place = place % sources
        is_source = rows.column("term").is_null().to_numpy()
        terms = int(rows.column("terms").to_numpy()[0])
        names, absent = {}, {}
        for b in {low, high}:
            at = np.flatnonzero(is_source & (block == b))
            at = at[np.argsort(place[at])]
            names[b], absent[b] = rows.column("source").combine_chunks().take(pa.array(at)), value[at]
        at = np.flatnonzero(~is_source)
        code = rows.column("term").combine_chunks().take(pa.array(at)).dictionary_encode().indices.to_numpy()
        order = np.argsort(code, kind="stable")
        at, code = at[order], code[order]
        n_terms = int(code[-1]) + 1 if len(code) else 0
        base = np.abs(absent[low][:, None] - absent[high])
        out = base * (terms if shard == 0 else 0) - base * n_terms
        step = max(1, CELLS // max(len(absent[low]), len(absent[high])))
        for a in range(0, n_terms, step):
            part = slice(*np.searchsorted(code, [a, a + step]))
            shares = {}
            for b in {low, high}:
                shares[b] = np.repeat(absent[b][None], min(step, n_terms - a), axis=0)
                own = at[part][block[at[part]] == b]
                shares[b][code[part][block[at[part]] == b] - a, place[own]] = value[own]
            for i in range(len(absent[low])):
                out[i] += np.abs(shares[high] - shares[low][:, i : i + 1]).sum(axis=0)
        i, j = np.triu_indices(len(absent[low]), 1) if low == high else np.indices(out.shape).reshape(2, -1)
        lang = pa.array([rows.column("lang")[0].as_py()] * len(i), pa.string())
        return pa.table([lang, names[low].take(pa.array(i)), names[high].take(pa.array(j)), pa.array(out[i, j], pa.int64())], schema=arrow_schema(_DISTANCES))

    return solve


def distances(groups: DataFrame, shares: DataFrame, size: int) -> DataFrame:
    """(lang, a, b, value) of every two sources of a lang: the sum over all kept terms of the difference of their shares."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cell = ["lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "shard", "block", "number", "source", "term", "value", "terms"]
    own = groups.select("*", F.col("absent").alias("value"), F.lit(None).cast("string").alias("term"), other).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(*cell)
    terms = shares.select("*", F.col("own").alias("value"), F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), other).withColumn("source", F.lit(None).cast("string")).select(*cell)
    return own.unionByName(terms).groupBy("lang", "low", "high", "shard").applyInArrow(_distances(size), _DISTANCES).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, sources: int = SOURCES, entries: int = ENTRIES) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(lang, source, text).

    Part pair: how far each other source of the lang is, all of them; part term: the top terms that a source writes more
    often than its lang does. Terms count that are in at least so many documents of the lang; sources and entries are the
    sizes of blocks and shards, on which the result doesn't depend. Null lang, source and text are ''. Each row is a document, repeated rows too; its doc_id
    isn't read. Texts may have any length; empty ones have no terms, but their source is one of its lang's. A lang without
    such terms has pairs of value 0. Ties go to the lesser item in bytes of UTF-8. An empty table
    gives no rows. Other columns, whatever their names, are not read.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = cut(kept_terms(plain, least))
    groups = cut(_groups(plain, kept, sources, entries))
    few = groups.count() <= FEW_GROUPS
    shares = kept.join(F.broadcast(groups) if few else groups, ["lang", "source"])
    shares = shares.withColumn("own", share(F.col("n"), F.col("total"), F.col("terms"))).withColumn("whole", share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = shares.where("own > whole").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("own") - F.col("whole")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = distances(groups, shares, sources).select("lang", "value", ways.alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(over)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 11 over the whole documents table."""
    return source_divergence(table(spark, sf_dir, "documents"))


_P = f"1 + (CAST({SCALE} AS HUGEINT) * (%s + {PRIOR})) // (%s + {PRIOR} * v)"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST_DOCUMENTS}) USING (lang, term) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {_P % ("coalesce(c.n, 0)", "s.total")} AS p, {_P % ("k.n", "l.total")} AS q FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank FROM r WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR rank <= {TOP}
"""

"""How five filters of a corpus interact: what each removes in every order, what only it finds, its Shapley value.

A document gets a mask of the filters that it fails. Of every lang the joint failures J(S) are counted for all 32 sets S of
filters, as sums of the products of their flags; everything else follows from these 32 numbers by inclusion and exclusion:

* survivors of the filters in T: the sum over S in T of (-1)^|S| J(S);
* removed by i after the filters in P: the sum over S in P of (-1)^|S| J(S + i); found by i alone: the same for all others;
* redundant: J(i) less what i removes;
* Shapley value of i (times 120, what it removes summed over all orders): Harsanyi's dividend of a set S is
  -(-1)^|S| J(S), shared equally by its members: the sum over S with i of 120 / |S| times the dividend.

Texts meet as SHA-256 digests, aggregated by what else matters before the least id of a digest is looked up, so that a text
of which there are any number of copies has a row for each lang and label there.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import map_arrow, table

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 200, 50, 3, "#$%&*|"
#: What the counts are of: all documents, those of good quality, toxic ones.
WEIGHTS = ["everything", "good", "toxic"]

_UPPER, _SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", SYMBOLS.encode()
_SETS = range(1 << len(FILTERS))


def failures(text: str | None) -> int:
    """The mask of the filters A to D (bits 0 to 3) that a text fails; null is the empty text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    tokens = data.split()
    few = len(tokens) < MIN_WORDS
    alike = 100 * len(set(tokens)) < MIN_DISTINCT * len(tokens)
    loud = 100 * (len(data) - len(data.translate(None, _UPPER))) > MAX_UPPER * len(text)
    signs = len(data.translate(None, _SIGNS)) < len(data)
    return few | alike << 1 | loud << 2 | signs << 3


def _judged(batches):
    for batch in batches:
        texts = [t.as_py() for t in batch.column(2)]
        digests = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts]
        yield [batch.column(0), batch.column(1), [failures(t) for t in texts], digests]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): the documents by all that the audit needs to know of them."""
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string"))
    judged = map_arrow(plain, _judged, "doc_id long, part string, mask int, digest binary")
    rows = judged.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    # of each text, lang and label: its documents, those without an id, the least id with its number of rows
    known_id = F.col("doc_id").isNotNull()
    texts = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(known_id, 0).otherwise(F.col("n"))).alias("no_id"), F.min(F.when(known_id, F.struct("doc_id", "n"))).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a row for each lang and label
    texts = texts.withColumn("unique", F.col("no_id") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    both = F.array(F.struct("mask", F.col("unique").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("unique")).alias("n")))
    return texts.select("part", "good", "toxic", F.explode(both).alias("x")).groupBy("part", "x.mask", "good", "toxic").agg(F.sum("x.n").alias("n"))


def joint_failures(found: DataFrame) -> DataFrame:
    """(part, an array of J(S) by S for each of WEIGHTS) from masks()."""

    def joint(weight: Column) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == s, F.col("n") * weight).otherwise(0)) for s in _SETS])

    return found.groupBy("part").agg(joint(F.lit(1)).alias(WEIGHTS[0]), *[joint(F.col(w)).alias(w) for w in WEIGHTS[1:]])


def _inverted(counts: str, holding: str, among: str) -> Column:
    """The sum over the sets S in among of (-1)^|S| J(S + holding)."""
    return F.expr(f"aggregate(filter(sequence(0, {_SETS[-1]}), s -> s & ~({among}) = 0), 0L, (sum, s) -> sum + if(bit_count(s) % 2 = 0, 1, -1) * {counts}[s | ({holding})])")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    docs(doc_id, text, lang), labels(doc_id, quality, toxic). One row for each lang, order of the five filters and step. A
    null lang is ''; null and empty texts are the same text without words; texts may have any length. Repeated rows count
    each. E fails a row if a row of a smaller doc_id has the same text, in whatever lang; rows of one id don't fail one
    another, and one without an id neither fails E nor makes others fail it. A document that several labels name is good
    or toxic if one of them says so; null labels and labels of no document say nothing. An empty table gives no rows, and
    no labels give zeros. Other columns, whatever their names, are not read.
    """
    joint = joint_failures(masks(docs, labels))
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    steps = joint.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = steps.withColumn("bits", F.expr(f"transform(sequence(1, {len(FILTERS)}), i -> shiftleft(1, instr('{FILTERS}', substr(filter_order, i, 1)) - 1))"))
    bits = bits.withColumn("own", F.expr("bits[step - 1]")).withColumn("earlier", F.expr("aggregate(slice(bits, 1, step - 1), 0, (all, b) -> all | b)"))
    removed, alone = _inverted(WEIGHTS[0], "own", "earlier"), _inverted(WEIGHTS[0], "own", f"{_SETS[-1]} - own")
    dividends = F.expr(f"aggregate(filter(sequence(0, {_SETS[-1]}), s -> s & own != 0), 0L, (sum, s) -> sum + if(bit_count(s) % 2 = 1, 1, -1) * (120 div bit_count(s)) * {WEIGHTS[0]}[s])")
    return bits.select(
        "part", "filter_order", "step",
        _inverted(WEIGHTS[0], "0", "earlier | own").alias("kept"),
        removed.alias("removed"),
        (F.expr(f"{WEIGHTS[0]}[own]") - removed).alias("redundant"),
        alone.alias("unique_fails"),
        _inverted("good", "own", "earlier").alias("good_lost"),
        _inverted("toxic", "own", "earlier").alias("toxic_lost"),
        dividends.alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 13 over the whole documents table and its labels."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
f AS (SELECT doc_id, part, [len(ws) < {MIN_WORDS}, 100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_UPPER} * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails FROM w),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN known USING (doc_id) GROUP BY ALL),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM (SELECT unnest(string_split('{FILTERS}', '')) AS x) a, (SELECT unnest(string_split('{FILTERS}', '')) AS x) b, (SELECT unnest(string_split('{FILTERS}', '')) AS x) c, (SELECT unnest(string_split('{FILTERS}', '')) AS x) d, (SELECT unnest(string_split('{FILTERS}', '')) AS x) e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
hit AS (SELECT t.*, filter_order, coalesce(list_min(list_filter(range(1, 6), lambda i: fails[instr('{FILTERS}', filter_order[i])])), 6) AS gone FROM t, o),
r AS (SELECT part, filter_order, step, instr('{FILTERS}', filter_order[step]) AS own, n, good, toxic, gone, fails[instr('{FILTERS}', filter_order[step])] AS failing, len(list_filter(fails, lambda x: x)) AS n_failing FROM hit JOIN s USING (filter_order)),
c AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE gone > step), 0) AS kept, coalesce(sum(n) FILTER (WHERE gone = step), 0) AS removed, coalesce(sum(n) FILTER (WHERE failing AND gone < step), 0) AS redundant, coalesce(sum(n) FILTER (WHERE failing AND n_failing = 1), 0) AS unique_fails, coalesce(sum(n) FILTER (WHERE gone = step AND good), 0) AS good_lost, coalesce(sum(n) FILTER (WHERE gone = step AND toxic), 0) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c
"""

"""Quality rules with thresholds that adapt to language and source.

Every measure of a text is a share in thousandths. Its distribution within a (lang, source) group is held as a mergeable
quantile sketch: counts of documents by thousandth, at most 1001 counters whatever the group's size, merged by adding
counters in any order, with an error of one thousandth in value and none in rank. From it comes the threshold of the
group: upper quartile + max(SPREAD x quartile distance, least slack of the measure). A group of fewer than FEW documents
takes the merged sketch of its language, a language of fewer that of the corpus. Sketches are of documents that pass the
base rules. The thresholds are joined back to the documents, which go if one measure is above its threshold.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import DOCUMENT_COLUMNS, cut, map_arrow, pair_hash, table

#: Measures (share of what, in thousandths) with the least slack above the upper quartile.
MEASURES = {"symbols": 50, "dup_lines": 250, "repeats": 150, "upper": 200, "stutter": 150}
SPREAD, FEW = 3, 50
#: Groups whose thresholds are broadcast, at most: some 100 bytes each.
FEW_GROUPS = 50_000
MIN_WORDS, MAX_REPEATS = 10, 20

_SPACES, _SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stutter"]


def measure(text: str | None) -> tuple[int, ...]:
    """The _COUNTS of one text; all 0 for null and empty ones.

    n_lines: lines with a word; n_upper: letters A-Z; n_stutter: words equal to the word before.
    """
    if not text:
        return (0,) * len(_COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    tokens = data.split()
    n, seen, lines, dup = len(tokens), set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = stutter = 0
    if n > 1:
        one = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, n)
        stutter = int((one[1:] == one[:-1]).sum())
        if n > 5:
            two = pair_hash(one[:-1], one[1:])
            five = pair_hash(pair_hash(two[:-2], two[2:])[:-1], one[4:])
            order = np.sort(five)
            twice = order[1:][order[1:] == order[:-1]]
            if len(twice):
                hit = np.flatnonzero(np.isin(five, twice))
                step = np.zeros(n + 1, np.int64)
                step[hit] += 1
                step[hit + 5] -= 1
                repeats = int((np.cumsum(step)[:n] > 0).sum())
    return (n, len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), dup, repeats, lines, len(data) - len(data.translate(None, _UPPER)), stutter)


def base_fails(n_words, n_repeat_words):
    """The fixed rules, for numbers and Columns: too few words, or too many in repeated windows."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATS * n_words)


def _measured(batches):
    for batch in batches:
        found = np.array([measure(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(_COUNTS))
        yield [*(c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "text" or batch.num_columns > 4), *found.T]


def counts(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, lang, source) and the _COUNTS of every row; with whole all DOCUMENT_COLUMNS."""
    if whole:
        plain, kind = docs.select(*DOCUMENT_COLUMNS), "doc_id long, text string, lang string, source string, n_chars long"
    else:
        plain, kind = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string")), "doc_id long, lang string, source string"
    return map_arrow(plain, _measured, kind + "".join(f", {c} long" for c in _COUNTS))


def shares() -> dict[str, F.Column]:
    """The measures from the counts, in whole thousandths."""
    share = lambda a, b: F.expr(f"1000 * {a} div greatest({b}, 1)")
    return {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "upper": share("n_upper", "word_chars"), "stutter": share("n_stutter", "n_words")}


def thresholds(found: DataFrame) -> DataFrame:
    """(lang, source, a threshold by measure) for every group of counted documents."""
    passed = found.where(~base_fails(F.col("n_words"), F.col("n_repeat_words")))
    bins = passed.select("lang", "source", F.explode(F.create_map(*[x for k, v in shares().items() for x in (F.lit(k), v)])).alias("measure", "bin"))
    own = bins.groupBy("lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n"))
    lang = own.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n"))
    all_ = lang.groupBy("measure", "bin").agg(F.sum("n").alias("n"))

    def limits(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
        whole = Window.partitionBy(*keys, "measure")
        ranked = sketch.withColumn("upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("total", F.sum("n").over(whole))
        at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), F.col("bin")))
        cut_at = ranked.groupBy(*keys, "measure").agg(F.first("total").alias("total"), at(0.25).alias("low"), at(0.75).alias("high"))
        slack = F.element_at(F.create_map(*[x for k, v in MEASURES.items() for x in (F.lit(k), F.lit(v))]), F.col("measure"))
        cut_at = cut_at.withColumn("limit", F.col("high") + F.greatest(SPREAD * (F.col("high") - F.col("low")), slack))
        return cut_at.groupBy(*keys).agg(F.first("total").alias(f"{name}_total"), F.map_from_entries(F.collect_list(F.struct("measure", "limit"))).alias(name))

    groups = found.select("lang", "source").distinct().alias("g")
    of_own, of_lang, of_all = limits(own, ["lang", "source"], "own").alias("o"), limits(lang, ["lang"], "of_lang").alias("l"), limits(all_, [], "of_all")
    joined = groups.join(of_own, F.expr("g.lang <=> o.lang and g.source <=> o.source"), "left").join(of_lang, F.expr("g.lang <=> l.lang"), "left")
    joined = joined.join(F.broadcast(of_all), F.lit(True), "left")  # one row
    chosen = F.when(F.col("own_total") >= FEW, F.col("own")).when(F.col("of_lang_total") >= FEW, F.col("of_lang")).otherwise(F.col("of_all"))
    return joined.select("g.lang", "g.source", chosen.alias("limits")).select("lang", "source", *[F.element_at("limits", k).alias(f"max_{k}") for k in MEASURES])


def beside(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """docs with their group's thresholds: sent to every task if the groups are few, joined by shuffle if not."""
    limits = cut(limits).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    few = limits.count() <= FEW_GROUPS
    return docs.join(F.broadcast(limits) if few else limits, F.expr("lang <=> t_lang and source <=> t_source"), "left").drop("t_lang", "t_source")


def _judged(found: DataFrame) -> DataFrame:
    """Counted documents with base_failed and kept."""
    both = beside(found, thresholds(found))
    above = [v > F.col(f"max_{k}") for k, v in shares().items()]
    bad = F.coalesce(F.array_max(F.array(*above)), F.lit(False))
    failed = base_fails(F.col("n_words"), F.col("n_repeat_words"))
    return both.select(*found.columns, failed.alias("base_failed"), (~failed & ~bad).alias("kept"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts, base_failed, kept) for every row of docs(doc_id, text, lang, source).

    Null and empty texts have no words and fail the base rules; texts may have any length. A null lang or source is a value
    of its own. Repeated rows count each, in the sketches too; a share equal to its threshold passes; null ids are judged
    like others. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    return _judged(cut(counts(docs)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 5 over the whole documents table."""
    return quality_verdicts(table(spark, sf_dir, "documents")).select("doc_id", *_COUNTS[:5], "base_failed", "kept")


def quality_by_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts where sources are two halves of the documents: groups large enough for thresholds of their own."""
    docs = table(spark, sf_dir, "documents").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    return quality_verdicts(docs).select("doc_id", "source", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go; all others stay as they are.

    Odd rows are judged as quality_verdicts says. Texts are measured once, and kept with their counts until they are judged.
    """
    return _judged(cut(counts(docs, whole=True))).where("kept").select(*DOCUMENT_COLUMNS)


ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
line_counts AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') <> '' GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
grams AS (SELECT doc_id, i, word, lag(word) OVER d AS before, CASE WHEN lead(word, 4) OVER d IS NOT NULL THEN word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d END AS g FROM pos WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, word, before, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS hit FROM grams),
word_counts AS (SELECT doc_id, count(*) FILTER (WHERE cover) AS n_repeat_words, count(*) FILTER (WHERE word = before) AS n_stutter FROM (SELECT doc_id, word, before, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS cover FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_stutter, 0) AS BIGINT) AS n_stutter FROM w LEFT JOIN line_counts USING (doc_id) LEFT JOIN word_counts USING (doc_id)),
s AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATS} * n_words AS base_failed, 1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * n_upper // greatest(word_chars, 1) AS upper_share, 1000 * n_stutter // greatest(n_words, 1) AS stutter FROM m),
long AS (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'upper', 'stutter']) AS measure, unnest([symbols, dup_lines, repeats, upper_share, stutter]) AS v FROM s WHERE NOT base_failed),
slack AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in MEASURES.items())}) AS t(measure, least)),
own AS (SELECT lang, source, measure, count(*) AS n, list_sort(list(v)) AS vs FROM long GROUP BY ALL),
by_lang AS (SELECT lang, measure, count(*) AS n, list_sort(list(v)) AS vs FROM long GROUP BY ALL),
whole AS (SELECT measure, count(*) AS n, list_sort(list(v)) AS vs FROM long GROUP BY ALL),
pick AS (SELECT g.lang, g.source, a.measure, least, CASE WHEN o.n >= {FEW} THEN o.vs WHEN l.n >= {FEW} THEN l.vs ELSE a.vs END AS vs FROM (SELECT DISTINCT lang, source FROM s) g CROSS JOIN whole a JOIN slack USING (measure) LEFT JOIN by_lang l ON l.measure = a.measure AND l.lang IS NOT DISTINCT FROM g.lang LEFT JOIN own o ON o.measure = a.measure AND o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source),
quart AS (SELECT lang, source, measure, least, vs[CAST(ceil(0.75 * len(vs)) AS BIGINT)] AS high, vs[CAST(ceil(0.25 * len(vs)) AS BIGINT)] AS low FROM pick),
lim AS (SELECT lang, source, map_from_entries(list((measure, high + greatest({SPREAD} * (high - low), least)))) AS t FROM quart GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(symbols > t['symbols'] OR dup_lines > t['dup_lines'] OR repeats > t['repeats'] OR upper_share > t['upper'] OR stutter > t['stutter'], false) AS kept
FROM s LEFT JOIN lim ON s.lang IS NOT DISTINCT FROM lim.lang AND s.source IS NOT DISTINCT FROM lim.source
"""
BY_HALF_SQL = ORACLE_SQL.replace("SELECT doc_id, lang, source, coalesce(text, '')", "SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, coalesce(text, '')").replace("SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed", "SELECT doc_id, s.source, base_failed")

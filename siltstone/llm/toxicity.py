"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are present or not: words, word beginnings of STEM bytes (inflected forms share them), pairs of
neighbours and pairs with one word between, hashed to 2**BITS places. FTRL-proximal has a rate of its own for every place,
and its L1 term leaves few places with a weight, so the whole model is some hundred numbers that every task can hold
(2**BITS at most).

Training rows are labelled rows outside the held-out fold, at most TRAIN_ROWS of them: those with the least hash of their
id. They are read in that order by one task, which holds their features only. Scores come from the text alone.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import DOCUMENT_COLUMNS, map_arrow, mix, table

#: The bound on the training sample.
TRAIN_ROWS = 16_000
BITS, STEM = 20, 4
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 5.0, 0.1, 3
THRESHOLD = 0.3

#: Letters in lower case, digits, apostrophes and whatever isn't ASCII stay; all else parts words.
_PARTS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 or c == 39 else 32 for c in range(256))
_MASK = np.uint64((1 << BITS) - 1)


def features(text: str | None) -> np.ndarray:
    """Hashed places of a text's features, with repeats; none for null, empty and wordless texts."""
    tokens = text.encode("utf-8", "surrogatepass").translate(_PARTS).split() if text else []
    n, digest = len(tokens), xxhash.xxh64_intdigest
    one = np.fromiter(map(digest, tokens), np.uint64, n)
    stems = np.fromiter((digest(t[:STEM], 9) for t in tokens), np.uint64, n)
    found = [one, stems]
    if n > 1:
        found.append(mix(one[:-1] * np.uint64(3) + one[1:]))
    if n > 2:
        found.append(mix(one[:-2] * np.uint64(5) + one[2:] + np.uint64(77)))
    return (np.concatenate(found) & _MASK).astype(np.uint32)


class Ftrl:
    """The learner: z and n of every place, weights derived from them."""

    def __init__(self):
        self.z, self.n, self.rows = np.zeros(1 + (1 << BITS)), np.zeros(1 + (1 << BITS)), 0  # the last place is the bias

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = np.where(at == 1 << BITS, 0.0, L1)  # the bias isn't shrunk
        return np.where(np.abs(z) <= free, 0.0, (np.sign(z) * free - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.rows += 1


def fit_rows(rows) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) learned from an iterable of (text, label). Features are held in a few large arrays."""
    model, parts, held, labels = Ftrl(), [], [], []

    def pack():
        parts.append((np.concatenate(held), np.cumsum([0, *map(len, held)]), list(labels)))
        held.clear()
        labels.clear()

    for text, label in rows:
        held.append(np.unique(features(text)))
        labels.append(label)
        if len(held) == 256:
            pack()
    if held:
        pack()
    for _ in range(EPOCHS):
        for places, bound, known in parts:
            for i, label in enumerate(known):
                model.learn(places[bound[i] : bound[i + 1]].astype(np.int64), label)
    places = np.arange(1 + (1 << BITS))
    w = model.weights(places)
    if not model.rows:
        w[-1] = -35.0  # nothing learned: nothing is toxic
    return places[w != 0], w[w != 0]


def score_text(text: str | None, dense: np.ndarray) -> float:
    at = features(text)
    at = at[dense[at] != 0]
    return float(1 / (1 + np.exp(-np.clip(dense[np.unique(at)].sum() + dense[-1], -35, 35))))


def held_out(doc_id) -> F.Column:
    """Whether a row belongs to the held-out fold: crc32 of its id as text, modulo 4, is 2. A null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) from docs(doc_id, text) and labels(doc_id, toxic); one distributed job, one bounded task."""
    ids = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("int").alias("y")).where("i is not null and y is not null")
    ids = ids.where(~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(rows)
    plain = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("text"))
    sample = plain.join(F.broadcast(ids), "i").groupBy("i", "y").agg(F.min("text").alias("text"))  # ids: at most `rows` rows
    sample = sample.select("i", "y", "text").repartition(1).sortWithinPartitions(F.xxhash64("i"), "i")

    def fit(batches):
        yield list(fit_rows((t.as_py(), y) for b in batches for y, t in zip(b.column(1).to_pylist(), b.column(2), strict=True)))

    got = map_arrow(sample, fit, "place int, weight double").toPandas()  # at most 2**BITS + 1 rows
    if not len(got):  # no row, no task
        return fit_rows(())
    got = got.sort_values("place")
    return got["place"].to_numpy(np.int64), got["weight"].to_numpy(np.float64)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text), by a model trained on docs and labels(doc_id, toxic).

    Null, empty and wordless texts score the bias. Labels that are null or have no document teach nothing; of several
    labels of an id the greatest counts, of several texts of an id the least. Without usable labels every score is 0
    (rounded). Repeated rows stay repeated; equal texts score alike; null ids are scored; texts may have any length. An
    empty table gives no rows. Other columns, whatever their names, are not read.
    """
    places, weights = train(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast((places, weights))

    def run(batches):
        dense = np.zeros(1 + (1 << BITS))
        dense[model.value[0]] = model.value[1]
        for batch in batches:
            yield [batch.column(0), [score_text(t.as_py(), dense) for t in batch.column(1)]]

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 3 over the whole documents table."""
    found = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score THRESHOLD or more go; all others stay as they are.

    Odd rows are scored as toxicity_scores says: null, empty and wordless texts by the bias, rows with a null id like others.
    """
    places, weights = train(docs, table(spark, sf_dir, "labels"))
    model = spark.sparkContext.broadcast((places, weights))
    plain = docs.select(*DOCUMENT_COLUMNS)

    def run(batches):
        dense = np.zeros(1 + (1 << BITS))
        dense[model.value[0]] = model.value[1]
        for batch in batches:
            keep = np.array([score_text(t.as_py(), dense) < THRESHOLD for t in batch.column(1)], bool)
            yield batch.filter(keep).columns

    return map_arrow(plain, run, "doc_id long, text string, lang string, source string, n_chars long")

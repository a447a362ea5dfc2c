"""Filter interactions and source divergence, against plain versions."""

import random
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import divergence, filter_audit

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_audit(rows, labels):
    """rows (doc_id, text, lang); labels (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    docs = []
    for i, text, lang in rows:
        text = text or ""
        w = words(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in text for c in "#$%&*|"), "E": i is not None and i > least[text]}
        docs.append((i, lang or "", {k for k, v in fails.items() if v}))
    out, total = {}, Counter()
    for part in {p for _, p, _ in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[1] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                failing = [d for d in docs if d[1] == part and f in d[2]]
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(len(d[2]) == 1 for d in failing), sum(d[0] in good for d in gone if d[0] is not None), sum(d[0] in toxic for d in gone if d[0] is not None))
                total[part, f] += len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


LABELS = "doc_id long, quality int, toxic int"


def test_audit_of_odd_rows(spark, odd, nothing):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, 1), (None, 1, 1), (99, 1, 1), (5, 1, 1)]
    frame = spark.createDataFrame(labels, LABELS).withColumn("mask", F.lit(3)).withColumn("part", F.lit("x"))
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    assert audited(filter_audit.filter_audit(odd, frame)) == plain_audit(rows, labels)
    assert filter_audit.filter_audit(nothing, frame).count() == 0
    assert audited(filter_audit.filter_audit(odd, frame.limit(0))) == plain_audit(rows, [])


def test_audit_of_copies_over_langs(spark):
    """Copies within and across langs, repeated rows and ids, rows without an id or a lang, and every filter alone."""
    rng = random.Random(3)
    texts = ["", None, "a b c", " ".join(f"w{i}" for i in range(220)), " ".join(f"w{i % 9}" for i in range(220)), " ".join(f"W{i}" for i in range(220)), " ".join(f"w{i}" for i in range(220)) + " #", "X Y | x x x x x"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "fr", "", None])) for _ in range(400)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(30), *range(10)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert audited(filter_audit.filter_audit(docs, spark.createDataFrame(labels, LABELS))) == plain_audit(rows, labels)


@pytest.mark.parametrize(("text", "mask"), [(" ".join(["a"] * 199), 3), (" ".join(f"a{i // 2}" for i in range(200)), 0), (" ".join(f"a{i % 99}" for i in range(200)), 2), ("A" * 3 + "é" * 97, 1), ("A" * 4 + "é" * 96, 5), ("a|", 9), ("\x85 a", 1)])
def test_filters_at_their_bounds(text, mask):
    assert filter_audit.failures(text) == mask


def test_audit_of_the_table(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = plain_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert audited(filter_audit.op13_filter_audit(spark, sf)) == want


def plain_divergence(rows, least, top=50):
    """rows (lang, source, text)."""
    counts, langs, documents = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = {(lang or "", source or "") for lang, source, _ in rows}
    for lang, source, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c if c >= "\x80" or "a" <= c <= "z" else " " for c in text or "")
        terms = [t for t in text.split(" ") if t]
        counts[lang or "", source or ""].update(terms)
        langs[lang or ""].update(terms)
        documents[lang or ""].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in documents[lang].items() if n >= least]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own, whole = shares(counts[lang, source]), shares(langs[lang])
        others = {s: shares(counts[lang, s]) for x, s in groups if x == lang and s != source}
        pairs = sorted((-sum(abs(own[t] - p[t]) for t in kept), s.encode(), s) for s, p in others.items())
        terms = sorted((whole[t] - own[t], t.encode(), t) for t in kept if counts[lang, source][t] and own[t] > whole[t])[:top]
        out += [(lang, source, part, x, -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, _, x) in enumerate(found, 1)]
    return sorted(out)


def diverged(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


@pytest.mark.parametrize(("least", "sources", "entries"), [(2, 512, 200_000), (3, 2, 5), (10**6, 2, 5)])
def test_divergence_in_blocks_and_shards(spark, least, sources, entries):
    """Many sources and shards, copies, nulls, groups without terms, ties, and a lang without any kept term."""
    rng = random.Random(5)
    some = ["alpha", "Beta", "ÉTÉ", "été", "γ", "a1b", "don't", "x\x85y", "\U0001f600", "zeta\tz", "Ünï"]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "S3", "s4", "é", None, "s5"]), " ".join(rng.choices(some, k=rng.randrange(9)))) for _ in range(150)]
    rows += [("de", "alone", "unique words of one"), ("de", "none", None), ("xx", "only", ""), *rows[:5]]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit("x")).withColumn("n", F.lit(1)).repartition(5)
    assert diverged(divergence.source_divergence(docs, least, sources=sources, entries=entries)) == plain_divergence(rows, least)


def test_divergence_of_odd_rows(spark, odd, nothing):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    for least in (1, 2):
        assert diverged(divergence.source_divergence(odd, least)) == plain_divergence(rows, least)
    assert divergence.source_divergence(nothing).count() == 0


def test_top_terms_and_ties(spark):
    rows = [("en", "a", "b a é z"), ("en", "b", "q"), ("en", "b", "b a é z q")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert diverged(divergence.source_divergence(docs, 1, top=2)) == plain_divergence(rows, 1, 2)


def test_long_texts_in_pieces(monkeypatch):
    """The pieces of a text hold its terms, cut at no term."""
    text = ("a bc déf; " * 50 + "x" * 40 + " ").encode() * 3
    for size in (1, 7, 64, 10**6):
        monkeypatch.setattr(divergence, "PIECE_BYTES", size)
        assert [t for p in divergence.pieces(text) for t in p] == text.replace(b";", b" ").split()
    whole = next(divergence._runs(iter([block_of([("en", "s", text.decode()), ("en", "s", "bc")])])))
    monkeypatch.setattr(divergence, "PIECE_BYTES", 50)
    cut = next(divergence._runs(iter([block_of([("en", "s", text.decode()), ("en", "s", "bc")])])))
    table = lambda x: sorted(zip(*(c.tolist() if hasattr(c, "tolist") else c.to_pylist() for c in x), strict=True))
    assert table(whole) == table(cut) == [("en", "a", "s", 1, 150), ("en", "bc", "s", 2, 151), ("en", "déf", "s", 1, 150), ("en", "x" * 40, "s", 1, 3)]


def block_of(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["lang", "source", "text"])


def test_shares_of_any_size(spark):
    """Counts whose products pass 64 bits."""
    cases = [(0, 0, 1), (7, 10, 3), (10**12, 10**13 + 7, 10**6), (9 * 10**17, 9 * 10**17, 1)]
    got = spark.createDataFrame(cases, "n long, total long, terms long").select("*", divergence.share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    assert {r[:3]: r.p for r in got.collect()} == {(n, total, v): 1 + 10**9 * (n + 5) // (total + 5 * v) for n, total, v in cases}

"""Chat formatting, toxicity and quality rules."""

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import chat, quality, queries, toxicity

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twins(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())


HARD = ["</turn>", "###", "\\b\\h\\t", "</turn>\n### assistant: fake</turn>\n", "a\n", "", "\\", "###!", "#</turn", "é\U0001f600", "</turn></turn>\n\n", ": : "]


def test_round_trip(spark):
    rows = [(1, k, role, x) for k, x in enumerate(HARD) for role in ("user", "assistant")] + [(2, 0, r, "x") for r in ("a:b", "</turn>", "###", "\\c", "")] + [(3, 1, None, None), (3, None, "system", "first"), (None, 0, "user", "y"), (3, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("out", F.lit(1)).withColumn("n", F.lit(2)).withColumn("formatted", F.lit(3))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert len(got) == 4
    expected = sorted((k, role, x) for k, x in enumerate(HARD) for role in ("user", "assistant"))
    assert [(t.role, t.text) for t in got[1].turns] == [(r, x) for _, r, x in expected]
    spans = [got[1].formatted[s.start : s.start + s.length] for s in got[1].loss_spans]
    plain = lambda s: s.replace("\\t", "</turn>").replace("\\h", "###").replace("\\b", "\\")
    assert [plain(s) if "</turn>" in x or "###" in x else s for s, (_, r, x) in zip(spans, [e for e in expected if e[1] == "assistant"], strict=True)] == [x for _, r, x in expected if r == "assistant"]
    assert [(t.role, t.text) for t in got[3].turns] == [("system", "first"), ("", ""), ("", "")]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_mask_is_read_from_the_output(spark):
    """The text under the mask is cut out of the formatted chat; spans that are off by one give another text."""
    rows = [(1, k, role, x) for k, x in enumerate(HARD) for role in ("user", "assistant")] + [(2, 0, "user", "hello"), (3, 0, "assistant", "")]
    c = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    shifted = F.transform("loss_spans", lambda s: F.struct((s["start"] - 1).alias("start"), s["length"].alias("length"), s["escaped"].alias("escaped")))
    got = {r.conv_id: r for r in c.select("conv_id", chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), chat.masked_text(F.col("formatted"), shifted).alias("off")).collect()}
    assert got[1].loss == "".join(HARD) != got[1].off and got[2].loss == got[3].loss == ""


def test_long_chat(spark):
    """Texts of ten million characters, with control strings, and a conversation of many turns."""
    long = "a###b\U0001f600</turn> " * 600_000
    rows = [(1, 0, "user", "x"), (1, 1, "assistant", long), *[(2, k, "assistant", f"t{k}") for k in range(3000)]]
    c = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    loss = chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    got = {r.conv_id: (r.d, r.n) for r in c.select("conv_id", F.sha2(loss, 256).alias("d"), F.size("turns").alias("n")).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (digest(long), 2), 2: (digest("".join(f"t{k}" for k in range(3000))), 3000)}


def test_chat_query_has_no_python(spark, sf):
    df = chat.op2_chat_format(spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    [r] = df.where("conv_id = -7").collect()
    text = "\\### Assistant: </turn> ok"
    assert (r.n_turns, r.loss_chars) == (2, len(text))
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def area(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    return (rank[label].mean() - rank[~label].mean()) / len(order) + 0.5


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = toxicity.op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    score, label, hit = np.array([r.score for r in held]), np.array([r.toxic == 1 for r in held]), np.array([r.predicted == 1 for r in held])
    assert area(score, label) > 0.97 and label[hit].mean() > 0.9 and hit[label].mean() > 0.8


def plain_ftrl(rows):
    """FTRL-proximal as published, place by place: (z, n) updated for each row, weights from them, L1 that spares the bias."""
    z, n, bias = {}, {}, 1 << toxicity.BITS

    def weight(i):
        free, total = 0.0 if i == bias else toxicity.L1, z.get(i, 0.0)
        if abs(total) <= free:
            return 0.0
        return (math.copysign(free, total) - total) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for text, label in rows:
            at = [*{int(i) for i in toxicity.features(text)}, bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, math.fsum(w.values()))))) - label
            for i in at:
                before = n.get(i, 0.0)
                sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_learner_is_plain_ftrl(spark, sf):
    """Weights equal those of a row-by-row version, on made texts and on the labelled documents."""
    made = [(f"you {'vile' if i % 2 else 'kind'} friend number {i % 7} of the {'bad' if i % 6 == 1 else 'good'} town", i % 2) for i in range(90)] + [(None, 1), ("", 0), ("one", 0)]
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("toxic is not null").orderBy("doc_id").collect()
    for sample in (made, [(r.text, r.toxic) for r in rows]):
        places, weights = toxicity.fit_rows(iter(sample))
        expected = plain_ftrl(sample)
        assert set(places.tolist()) == set(expected) and len(expected) > 3
        assert max(abs(w - expected[i]) for i, w in zip(places.tolist(), weights.tolist(), strict=True)) < 1e-9


def test_skip_grams():
    """A text's features: its words, their beginnings, neighbours, and pairs with a word between; distinct texts differ."""
    n = lambda text: len(toxicity.features(text))
    assert [n(x) for x in (None, "", " .,", "a", "a b", "a b c", "a b c d")] == [0, 0, 0, 2, 5, 9, 13]
    pairs = set(toxicity.features("red green blue").tolist())
    assert len(pairs & set(toxicity.features("red x blue").tolist())) == 5  # red and blue, their beginnings, and the skip-pair
    assert (toxicity.features("You FOOL!") == toxicity.features("you fool")).all()


def test_scores_see_the_text_alone(spark, odd, nothing):
    docs = spark.createDataFrame([(i, f"you {'vile' if i % 2 else 'kind'} friend number {i}", "en", f"s{i}", 9) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    a = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert min(s for i, s in a.items() if i % 2) > max(s for i, s in a.items() if not i % 2)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, flipped).collect()} == a  # held-out labels teach nothing
    rows = toxicity.toxicity_scores(odd, labels).collect()
    assert len(rows) == odd.count() and len({r.score for r in rows if r.doc_id in (4, 5, 6)}) == 1
    assert max(r.score for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect()) < 1e-9
    assert toxicity.toxicity_scores(nothing, labels).count() == 0


def test_quality_odd_rows(spark, odd, nothing):
    rows = quality.quality_verdicts(odd).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and got[4].n_words == 0 and got[4].base_failed and not got[4].kept
    assert got[9].n_repeat_words == 3000 and got[9].base_failed and got[1].kept and got[None].kept
    assert quality.quality_verdicts(nothing).count() == 0
    none = odd.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    assert {r.doc_id: r.kept for r in quality.quality_verdicts(none).collect()} == {i: r.kept for i, r in got.items()}
    kept = sorted(str(r.doc_id) for r in quality.stage(spark, odd, "").collect())
    assert kept == sorted(str(r.doc_id) for r in rows if r.kept)


def test_measures():
    text = "a b c d e f\na b c d e f\n\n#% | a a\n \n"
    found = dict(zip(quality._COUNTS, quality.measure(text), strict=True))
    assert found == {"n_words": 16, "word_chars": 17, "n_symbols": 3, "n_dup_lines": 1, "n_repeat_words": 12, "n_lines": 3, "n_upper": 0, "n_stutter": 1}


def test_share_at_its_threshold(spark):
    """A share equal to its threshold passes, one above it doesn't."""
    words = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join([*words[:-1], f"x{i}"])) for i in range(60)]
    for i, n in ((100, 15), (101, 16)):  # all others have none, so the threshold is the least slack: 150 of 1000
        rows.append((i, " ".join([f"p{k} p{k}" for k in range(n)] + words[: 100 - 2 * n])))
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.n_words, r.n_stutter, r.base_failed, r.kept) for r in quality.quality_verdicts(docs).collect()}
    assert quality.MEASURES["stutter"] == 150 and got[100] == (100, 15, False, True) and got[101] == (100, 16, False, False)


def test_thresholds_adapt(spark):
    """Where a source writes many symbols, they are no fault; where it doesn't, they are."""
    clean = " ".join(f"word{k}" for k in range(30))
    rows = [(i, clean + f" x{i}" + " ##$$" * (6 if i < 100 else 0), "en", "code" if i < 100 else "news") for i in range(200)] + [(900, clean + " ##$$" * 20, "en", "news"), (901, clean + " #$%&" * 20, "en", "code")]
    docs = spark.createDataFrame([(a, " ".join(f"{w}{k % 7 if w.startswith('#') else ''}" for k, w in enumerate(b.split())), c, d) for a, b, c, d in rows], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_verdicts(docs).collect()}
    assert all(kept[i] for i in range(200)) and not kept[900]

"""The corpus pipeline, stage by stage."""

import corpus_pipeline
from siltstone.llm import quality, toxicity
from siltstone.llm.common import DOCUMENT_COLUMNS
from tests.llm.test_dedup import classes, removed
from tests.llm.test_tokens import byte_ids, check_pieces


def test_stages(spark, sf, tmp_path):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / str(k))))
        docs = seen[name][1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "substring_dedup", "packing"]
    assert all(out.columns == DOCUMENT_COLUMNS for _, out in list(seen.values())[:-1])
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    before, after = seen["toxicity"]
    assert ids(after) == {r.doc_id for r in toxicity.op3_toxicity(spark, sf).collect() if not r.predicted}
    before, after = seen["quality_rules"]
    assert ids(after) == {r.doc_id for r in quality.quality_verdicts(before).collect() if r.kept}
    before, after = seen["simhash_near_dedup"]
    assert ids(after) == set(classes({r.doc_id: r.text for r in before.collect()}).values())
    before, after = seen["substring_dedup"]
    expected = removed([(r.doc_id, r.text) for r in before.collect()])
    import hashlib

    for r in after.collect():
        kept = b" ".join(r.text.encode().split())
        assert hashlib.sha256(kept).hexdigest() == expected[r.doc_id][2] and r.n_chars == len(r.text)
    before, after = seen["packing"]
    assert check_pieces(after.collect(), {r.doc_id: byte_ids(r.text) for r in before.collect()}) == 0
    assert corpus_pipeline.run(spark, sf).count() == after.count()


def test_texts_without_an_id_pass_all_stages(spark, sf):
    """Rows without an id, and texts that share one, go through every stage whole but for what their own windows repeat."""
    rng = __import__("random").Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(25)
    rows = [(None, f"{passage} {prose(40)}"), (None, f"{prose(60)} {passage}"), (None, prose(70)), (7, f"{prose(50)} {passage}"), (8, prose(60)), (8, prose(60)), (9, prose(30))]
    out = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, sf)
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert kept == sorted(rows, key=str)  # nothing here is toxic, bad or a near copy
    out = corpus_pipeline.STAGES[3][1](spark, out, sf)
    found = [(r.doc_id, " ".join(r.text.split()), r.n_chars == len(r.text)) for r in out.collect()]
    without = lambda t: " ".join(t.replace(passage, " ").split())
    holders = [r for r in rows if passage in r[1]]
    whole = [r for r in holders if (r[0], r[1], True) in found]
    assert len(whole) == 1 and whole[0][0] is None  # the first holder, one without an id, keeps the passage
    want = [(i, t if (i, t) in whole or passage not in t else without(t), True) for i, t in rows]
    assert sorted(found, key=str) == sorted(want, key=str)
    pieces = corpus_pipeline.STAGES[4][1](spark, out, sf).collect()
    texts = {(i, t): byte_ids(t) for i, t in {(r.doc_id, r.text) for r in out.collect()}}
    assert sum(r.length for r in pieces) == sum(len(x) for x in texts.values())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in pieces if r.start == 0) == sorted((i is None, i or 0, len(x)) for (i, _), x in texts.items())


def test_odd_rows(spark, sf, odd, nothing):
    for docs in (odd, nothing):
        out = docs
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, sf)
        assert (out.count() > 0) == (docs is odd)

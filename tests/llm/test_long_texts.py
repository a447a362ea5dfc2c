"""A text of ten megabytes, a copy of it and a short one, through every operator on texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from siltstone.llm import divergence, filter_audit, near_copies, packing, quality, simhash, substring_dedup, token_count, toxicity

PERIOD, WORDS = 5000, 1_600_000


@pytest.fixture(scope="module")
def long_text():
    return " ".join([f"w{i % PERIOD}" for i in range(WORDS)])


@pytest.fixture(scope="module")
def long_docs(spark, long_text):
    rows = [(1, long_text, "en", "s"), (2, long_text, "en", "s"), (3, "a short text of words", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).cache()


def test_substring_dedup(long_docs, long_text):
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.remove_repeats(long_docs).collect()}
    first = " ".join(long_text.split()[:PERIOD]).encode()
    assert len(long_text) > 9_000_000
    assert got == {1: (WORDS, WORDS - PERIOD, first), 2: (WORDS, WORDS, b""), 3: (5, 0, b"a short text of words")}


def test_scores_and_counts(spark, long_docs, long_text):
    labels = spark.createDataFrame([(3, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(long_docs, labels).collect()}
    assert got[1] == got[2] and set(got) == {1, 2, 3}
    q = {r.doc_id: r for r in quality.quality_verdicts(long_docs).collect()}
    assert (q[1].n_words, q[1].n_repeat_words, q[1].word_chars, q[1].kept) == (WORDS, WORDS, len(long_text) - WORDS + 1, False)
    counts = {r.doc_id: tuple(r)[1:] for r in token_count.token_counts(long_docs).collect()}
    assert counts[1] == counts[2] and counts[1][0] == WORDS and counts[1][1] >= WORDS


def test_simhash(long_docs, long_text):
    words = long_text.encode().split()
    ones = np.zeros(64, np.int64)
    for gram, n in Counter(zip(words, words[1:], words[2:], strict=False)).items():
        h = xxhash.xxh64_intdigest(b" ".join(gram), 42)
        ones += n * np.array([h >> b & 1 for b in range(64)])
    expected = sum(1 << b for b in range(64) if 2 * ones[b] > len(words) - 2)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(long_docs).collect()}
    assert got[1] == got[2] == (expected, 1) and got[3][1] == 3
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(long_docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_audits(spark, long_docs):
    """Long texts in the filter audit and in the divergence of sources, in one piece and in several."""
    joint = {r.part: r.everything for r in filter_audit.joint_failures(filter_audit.masks(long_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect()}["en"]
    # the long ones repeat words (B), the second is a copy (E), the short one has few words (A)
    assert joint[0] == 3 and joint[1] == 1 and joint[2] == 2 and joint[16] == 1 and joint[2 | 16] == 1 and joint[4] == joint[8] == joint[1 | 2] == 0
    rows = divergence.kept_terms(long_docs.select("lang", "source", "text"), 2).collect()
    assert {(r.term, r.n, r.lang_n, r.new) for r in rows} == {("w", 2 * WORDS, 2 * WORDS, 1)}


def test_tokenizers(long_docs, long_text):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from siltstone.llm import bpe

    ids = Tokenizer.from_file(public.path("word_bpe_49k.json")).encode(long_text, add_special_tokens=False).ids
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(long_docs)).collect()}
    digest = lambda x: hashlib.sha256(str(x).encode()).hexdigest()
    assert len(got[1].ids) == len(ids) and digest(list(got[1].ids)) == digest(ids) == digest(list(got[2].ids))
    byte = [*Tokenizer.from_file(public.path("byte_bpe_50k.json")).encode(long_text, add_special_tokens=False).ids, packing.END]
    pieces = sorted((r.start, bytes(r.ids)) for r in packing.pack(long_docs).where("doc_id = 1").collect())
    assert b"".join(x for _, x in pieces) == np.array(byte, "<u4").tobytes() and len(pieces) >= len(byte) / packing.WINDOW

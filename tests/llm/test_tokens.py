"""Tokenizers, token counts and packing against the libraries and plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from siltstone.llm import bpe, packing, token_count  # noqa: E402
from tests.llm.conftest import TEXTS  # noqa: E402

WORD, BYTE = Tokenizer.from_file(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
HARD = [None, "", " ", "  a  b ", "a \n b\n\n c ", "x<|endoftext|> y<|startoftext|>", "I'M don't we'll 123", "ﬁ Σας ΣΑΣ İx é", "中文 字　x y", "aaaaaaa hahahaha", "\U0001f600\U0001f600", "a\x1cb \x1c c\x85d", "tab\tx \ty", "a <| b", "end\n"]


def word_ids(text):
    return WORD.encode(text or "", add_special_tokens=False).ids


def byte_ids(text):
    return [*BYTE.encode(text or "", add_special_tokens=False).ids, 1]


def encoded(texts):
    parts = bpe.word_bpe(bpe.tokenizer_file()).encode_texts(pa.array(texts, pa.string()), 3)
    return [ids[a:b].tolist() for ids, bound in parts for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


def tokenized(texts):
    ids, bound = packing.tokenize(pa.array(texts, pa.string()), packing.ranks_file())
    return [ids[a:b].tolist() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


def test_hard_texts():
    assert encoded(HARD) == [word_ids(t) for t in HARD]
    assert tokenized(HARD) == [byte_ids(t) for t in HARD]
    assert encoded([]) == tokenized([]) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aAbé's  \n\t.,!1 ß中ſ-")), max_size=30), max_size=6))
def test_any_texts(texts):
    assert encoded(texts) == [word_ids(t) for t in texts]
    assert tokenized(texts) == [byte_ids(t) for t in texts]


def test_bpe_query(spark, sf, texts):
    rows = bpe.op7_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = word_ids(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(WORD.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(odd, nothing):
    rows = bpe.decode(bpe.encode(odd)).collect()
    assert sorted(map(str, (r.ids for r in rows))) == sorted(str(word_ids(t)) for _, t in TEXTS)
    assert all(r.decoded == WORD.decode(r.ids, skip_special_tokens=False) for r in rows)
    assert bpe.encode(nothing).count() == 0


def longest(word, pieces):
    n = i = 0
    while i < len(word):
        j = len(word)
        while word[i:j] not in pieces:
            j -= 1
        n, i = n + 1, j
    return n


def test_longest_match():
    rng = random.Random(3)
    for _ in range(40):
        pieces = {bytes([b]) for b in range(256)} | {bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(rng.randint(0, 30))}
        automaton = token_count.LongestMatch(pieces)
        for _ in range(60):
            word = bytes(rng.choices(b"abcd", k=rng.randint(0, 25)))
            assert automaton.count(word) == longest(word, pieces)
    with pytest.raises(ValueError):
        token_count.LongestMatch([b"a", b"bc"])


def test_token_count_query(spark, sf, texts, odd, nothing):
    import base64

    with open(token_count.ranks_file(), "rb") as lines:
        pieces = {base64.b64decode(x.split()[0]) for x in lines}
    rows = token_count.op8_token_counts(spark, sf).collect()
    expected = {i: (len((t or "").encode().split()), sum(longest(b" " + w, pieces) for w in (t or "").encode().split())) for i, t in texts.items()}
    assert {r.doc_id: (r.n_words, r.n_tokens) for r in rows} == expected
    got = token_count.token_counts(odd).collect()
    assert len(got) == odd.count() and {(4, 0, 0), (5, 0, 0), (6, 0, 0), (7, 1, 1)} <= {tuple(r) for r in got}
    assert token_count.token_counts(nothing).count() == 0


def check_pieces(rows, ids):
    by_doc, by_sequence, padding = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.length > 0
    for i, x in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            part = np.array(x[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(part))
            at += r.length
        assert at == len(x)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        padding += packing.WINDOW - at if at & (at - 1) else 0
    return padding


def test_packing_query(spark, sf, texts):
    rows = packing.op9_packing(spark, sf).collect()
    assert check_pieces(rows, {i: byte_ids(t) for i, t in texts.items()}) == 0


def test_packing_odd_rows(spark, odd, nothing):
    unique = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pieces(unique.repartition(3)).collect()
    assert check_pieces(rows, {i: byte_ids(t) for i, t in TEXTS if i is not None}) == 0
    assert packing.pieces(odd).where("doc_id = 5").count() == 2 and packing.pieces(odd).where("doc_id is null").count() >= 1
    assert packing.pieces(nothing).count() == 0


def test_neighbours_come_first():
    """A window is filled by the documents that share rare words with its seed."""
    words = {w: i for i, w in enumerate("alpha beta gamma delta common x y z".split())}
    docs = ["alpha beta common x", "delta z common", "gamma y common", "alpha beta common y"]
    numbers = [np.array([words[w] for w in d.split()]) for d in docs]
    index = packing.Bm25(np.concatenate(numbers), np.append(0, np.cumsum([len(x) for x in numbers])), len(words))
    assert set(index.scores(0).argsort()[::-1].tolist()[:2]) == {0, 3}
    pieces = packing.pack_shard([1000, 900, 900, 800], index.scores)
    first = [p[0] for p in pieces if p[3] == 0]
    assert first[:2] == [0, 3]
    assert sum(p[2] for p in pieces) == 3600
    assert packing.pack_shard([5000], lambda s: np.zeros(1)) == [(0, 0, 2048, 0, 0), (0, 2048, 2048, 1, 0), (0, 4096, 512, 2, 0), (0, 4608, 256, 3, 0), (0, 4864, 128, 4, 0), (0, 4992, 8, 5, 0)]


def bm25(words):
    """scores(a) of all texts for all distinct words of text a, by the formula alone."""
    import math
    from collections import Counter

    held, df = [Counter(w) for w in words], Counter(x for w in words for x in set(w))
    n, mean = len(words), max(1.0, sum(map(len, words)) / max(1, len(words)))
    idf = {x: math.log1p((n - k + 0.5) / (k + 0.5)) for x, k in df.items()}

    def score(a, b):
        norm = packing.K1 * (1 - packing.B + packing.B * len(words[b]) / mean)
        return sum(idf[x] * held[b][x] * (packing.K1 + 1) / (held[b][x] + norm) for x in held[a] if x in held[b] and df[x] > 1)

    return lambda a: [score(a, b) for b in range(n)]


def test_windows_are_filled_by_whole_corpus_neighbours(spark, sf):
    """Where the corpus is one shard, each next document of a window is the unused one with the highest BM25 score of all."""
    docs = [(r.doc_id, r.text) for r in packing.in_shards(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).collect()]
    assert sum(len((t or "").encode()) for _, t in docs) < packing.SHARD_BYTES
    scores, place = bm25([(t or "").lower().split() for _, t in docs]), {i: k for k, (i, _) in enumerate(docs)}
    rows = sorted(packing.op9_packing(spark, sf).collect(), key=lambda r: (r.sequence_id, r.offset))
    windows, free, best, seed = {}, set(range(len(docs))), None, None
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
    chosen = agreed = 0
    for own in windows.values():
        if sum(r.length for r in own) < packing.WINDOW:
            continue  # the last window, cut at powers of two
        seed = None
        for r in own:
            k = place[r.doc_id]
            if r.start == 0 and seed is not None:
                now = scores(seed)
                best = max((now[j] for j in free), default=0)
                chosen += 1
                agreed += now[k] >= best * (1 - 1e-5) - 1e-9
            free.discard(k)
            seed = k if seed is None and r.start + r.length == r.doc_tokens else seed
    assert chosen > 30 and agreed == chosen


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(-3, 3)), min_size=1, max_size=30))
def test_keys_sort_as_rows(rows):
    keys = packing._keys(*(np.array(c, np.int64) for c in zip(*rows, strict=True)))
    order = sorted(range(len(rows)), key=lambda i: rows[i])
    assert (np.diff(np.searchsorted(np.sort(keys), keys[order])) >= 0).all()


def test_related_documents_share_a_shard(spark, monkeypatch):
    """Edited copies stand side by side wherever they were: most of them meet in one of many shards."""
    monkeypatch.setattr(packing, "SHARD_BYTES", 20_000)
    rng = np.random.default_rng(2)
    rows = []
    for g in range(300):
        words = [f"w{x}" for x in rng.integers(0, 20_000, 120)]
        for copy in range(2):
            changed = [f"c{rng.integers(10**9)}" if rng.random() < 0.05 else w for w in words]
            rows.append((g + 1000 * copy, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_h0", packing.F.lit("x"))
    shard = {r.doc_id: r.shard for r in packing.in_shards(docs.select("doc_id", "text")).collect()}
    assert len(set(shard.values())) > 10 and np.mean([shard[g] == shard[g + 1000] for g in range(300)]) > 0.75
    assert check_pieces(packing.pieces(docs).collect(), {i: byte_ids(t) for i, t in rows}) < 2048


def test_neighbours_by_all_words():
    """BM25 over every word of the seed: also a document that shares none of its rarest words is scored."""
    import math

    docs = [[*range(20), 90, 91], list(range(20)), [90, 91, 50], [90, 91, 51], [60, 61]]
    bound = np.append(0, np.cumsum([len(d) for d in docs]))
    index, mean = packing.Bm25(np.concatenate([np.array(d) for d in docs]), bound, 100), bound[-1] / len(docs)

    def score(d):
        total = 0
        for w in set(docs[0]) & set(d):
            df = sum(w in x for x in docs)
            norm = packing.K1 * (1 - packing.B + packing.B * len(d) / mean)
            total += math.log1p((len(docs) - df + 0.5) / (df + 0.5)) * d.count(w) * (packing.K1 + 1) / (d.count(w) + norm)
        return total

    assert np.allclose(index.scores(0)[1:], [score(d) for d in docs[1:]], rtol=1e-5) and index.scores(0)[2] > 0


def test_shards_depend_on_documents_alone(spark):
    """However the documents lie in partitions, each goes to the same shard."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = [{r.doc_id: r.shard for r in packing.in_shards(docs.repartition(n)).select("doc_id", "shard").collect()} for n in (3, 7)]
    assert found[0] == found[1] and len(set(found[0].values())) > 2

"""Byte-pair encoding and decoding with a pair occurrence index.

A task takes its documents in bounded blocks and lays the distinct words of a block into one array of symbols. The index
maps every pair of neighbours that has a merge rank to all its positions in the block. Active ranks are applied in
ascending order from a heap: one step merges all positions of a pair at once, and only the pairs next to them are looked
up again and added to the lists of their ranks. Positions that a merge has made stale are recognised when their rank's
turn comes. Documents are put together from the encoded words.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import blocks, map_arrow, spread, table

#: Bytes of a block.
BLOCK_BYTES = 12_000_000

_DEAD = -2
_NONE = np.iinfo(np.int32).max
_SPLIT = regex.compile(r"[^\S\x1c-\x1f]+")
_ODD = r"[\x1c-\x1f]|<\|"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else the next free ones."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(free)
            free += 1
    return [letters[b] for b in range(256)]


class Numbering(dict):
    """Numbers for things in the order in which they come."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class WordBpe:
    """A tokenizer file with word ends: vocabulary, ranked merges and special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters, end = spec["model"]["vocab"], byte_letters(), spec["model"]["end_of_word_suffix"] or ""
        self.first = np.array([vocab.get(c, -1) for c in letters], np.int32)
        self.last = np.array([vocab.get(c + end, -1) for c in letters], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.pair = list(zip(left.tolist(), right.tolist(), [vocab[a + b] for a, b in merges], strict=True))
        order = np.argsort(left << 32 | right, kind="stable")
        self.keys, self.ranks = (left << 32 | right)[order], order.astype(np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        self.by_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        rules = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = rules.normalizer, rules.pre_tokenizer
        self.byte_of = {c: b for b, c in enumerate(letters)}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs; _NONE for those without one."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], _NONE)

    def words_of(self, chunk: str) -> list[bytes]:
        """The words of a run of characters without white space, as the tokenizer's rules split it."""
        if max(chunk) < "ɐ":  # up to here characters have no compositions, and every Unicode version agrees
            return [w.encode() for w in self.pieces.findall(chunk.lower())]
        found = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(chunk))
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in found]

    def chunks_of(self, text: str) -> list[str]:
        """The runs of other than white space of any text; special strings stand for themselves wherever they are."""
        split = lambda t: [x for x in _SPLIT.split(t) if x]
        return [x for i, part in enumerate(self.by_special.split(text)) for x in ([part] if i % 2 else split(part))]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, bounds of each word among them), by the pair occurrence index."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size)
        n = len(data)
        begin = end - size
        sym = np.append(self.first[data], np.int32(-1))
        tail = end[size > 0] - 1
        sym[tail] = self.last[data[tail]]
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        nxt[tail] = nxt[n] = n  # n stands for the outside of a word
        prv[begin[size > 0]] = n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.rank(sym[at], sym[nxt[at]])
            at, rank = at[rank != _NONE], rank[rank != _NONE]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edge = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, where in zip(rank[np.append(0, edge)].tolist(), np.split(at, edge), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(where)

        add(np.arange(n, dtype=np.int32))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, new = self.pair[r]
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
            if a == b and len(at) > 1:  # of overlapping positions every other one, from the left
                fresh = np.append(True, nxt[at[:-1]] != at[1:])
                at = at[(np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
            if not len(at):
                continue
            right = nxt[at]
            after = nxt[right]
            sym[at], sym[right] = new, _DEAD
            nxt[at], prv[after] = after, at
            near = np.concatenate([prv[at], at])
            add(np.unique(near[near < n]))
        alive = sym[:n] >= 0
        upto = np.append(0, np.cumsum(alive))
        return sym[:n][alive], np.append(0, upto[end])

    def encode_texts(self, texts: pa.Array, step: int = 512):
        """For each step texts: (their ids in a row, bounds of each text among them).

        Texts are split at white space and their chunks numbered by Arrow; Python sees each distinct chunk once. Texts
        with special strings or control characters that only some call white space are split by patterns.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        lists = pc.utf8_split_whitespace(pc.if_else(pa.array(odd), "", texts))
        bound, coded = lists.offsets.to_numpy().astype(np.int64), lists.values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        at, number = coded.indices.to_numpy().astype(np.int64), {c: i for i, c in enumerate(names)}
        if odd.any():
            new = Numbering(number)
            others = {i: [new[c] for c in self.chunks_of(texts[i].as_py())] for i in np.flatnonzero(odd).tolist()}
            parts = [np.array(others[i], np.int64) if i in others else at[a:b] for i, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True))]
            names, at = list(new), np.concatenate(parts)
            bound = np.append(0, np.cumsum([len(x) for x in parts]))
        word = Numbering()
        special, chunks = self.special, []
        for c in names:
            chunks.append([-1 - special[c]] if c in special else list(map(word.__getitem__, self.words_of(c))) if c else [])
        ids, to = self.encode_words(list(word))
        n = len(word)  # after the words come the special tokens, a list each
        ids, to = np.append(ids, np.array(list(special.values()), ids.dtype)), np.append(to, to[-1] + 1 + np.arange(len(special)))
        place = {-1 - i: n + k for k, i in enumerate(special.values())}
        flat = np.array([place.get(w, w) for c in chunks for w in c], np.int64)
        of_chunk = np.append(0, np.cumsum([len(c) for c in chunks])).astype(np.int64)
        size = np.append(0, np.cumsum((to[1:] - to[:-1])[flat])) if len(flat) else np.zeros(1, np.int64)
        coded_ids, _ = spread(ids, to, flat)  # the ids of each distinct chunk
        ends = size[of_chunk]
        for k in range(0, len(texts), step):  # what is spread out is bounded
            part = bound[k : k + step + 1]
            out, upto = spread(coded_ids, ends, at[part[0] : part[-1]])
            yield out, upto[part - part[0]]


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(2)
def token_names(path: str) -> pa.Array:
    """The token of each id."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return pa.array([tokens.get(i, "") for i in range(max(tokens) + 1)])


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row of docs(doc_id, text), without special tokens of its own.

    Null and empty texts have no ids. Special strings within a text are their ids, as the tokenizers library has it.
    Texts may have any length. Repeated rows and null ids are encoded like others. An empty table gives no rows. Other
    columns are not read.
    """
    path = path or tokenizer_file()

    def run(batches):
        model = word_bpe(path)
        for block in blocks(batches, BLOCK_BYTES):
            for k, (ids, bound) in enumerate(model.encode_texts(block.column(1), 512)):
                yield [block.column(0).slice(512 * k, 512), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(ids, pa.int32()))]

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of coded(doc_id, ids): the tokens joined by one space, special ones too; null ids: none.

    Lists may have any length. Repeated rows stay repeated, and null doc_ids are kept. An empty table gives no rows.
    """
    path = path or tokenizer_file()

    def run(batches):
        names = token_names(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                ids = whole.column(1).slice(k, 512)
                size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), names.take(ids.flatten()))
                yield [whole.column(0).slice(k, 512), ids, pc.binary_join(lists, " ")]

    return map_arrow(coded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, decoded string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 7 over the whole documents table."""
    found = decode(encode(table(spark, sf_dir, "documents")))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Packing of documents into training sequences by lexical retrieval.

The corpus is cut into shards of bounded size in which related documents meet: documents are sorted by min-hashes of their
words, so that two of them get the same first one, and stand side by side, with the probability of their lexical
similarity. The sort is one range shuffle; shards depend on the documents alone, not on files, partitions or cores.

A shard is tokenized, and an inverted index with BM25 weights is built over its words. A seed document opens a window; the
index returns the unused documents closest to the seed by all its words, and these fill the window one after another. The
one that reaches the end is cut there, and what is left of it is the next seed. Windows are full but for the last of a
shard, which is split at powers of two, lengths that need no padding. What a task holds doesn't grow with the corpus.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import map_arrow, mix, spread, table

WINDOW, END = 2048, 1
#: Bytes of a shard; shards of a partition once there are partitions enough for all cores; shards, at most.
SHARD_BYTES, PER_PARTITION, MAX_SHARDS = 8_000_000, 4, 400_000
#: Min-hashes that documents are sorted by, one after another.
SORT_HASHES = 3
#: Documents sampled for the borders of the shards: a share that gives some twenty a shard of usual texts, within bounds.
SAMPLE, LEAST_SAMPLE, MOST_SAMPLE = 0.01, 2_000, 200_000
K1, B = 1.2, 0.75
_HASHES = 1 << 40

#: A run of white space and the run of other characters after it: the tokenizer's pieces never cross a border between them.
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*(?:\S|[\x1c-\x1f])+|[^\S\x1c-\x1f]+")
#: Texts in which not every single space starts a chunk: white space after a space, a space at the end, special strings.
_UNEVEN = r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| $|<\|"


@lru_cache(2)
def byte_bpe(ranks_path: str, special: str = "<|endoftext|>", special_id: int = 50256):
    """(encode a text, bytes of each id, special string, its id) of a byte-level BPE vocabulary; equal to its tokenizers file."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = [len(x) for x in ranks]
    return encoding.encode_ordinary, size, special, special_id


def ranks_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Chunks(dict):
    """Numbers for the distinct chunks of a shard, and their ids."""

    def __init__(self, path: str):
        self.encode, self.size, self.special, self.special_id = byte_bpe(path)
        self.ids: list[list[int]] = []

    def __missing__(self, chunk: str) -> int:
        found = [self.special_id] if chunk == self.special else self.encode(chunk)
        self[chunk] = n = len(self.ids)
        self.ids.append(found)
        return n

    def of(self, text: str) -> list[int]:
        """Chunk numbers of any text; special strings are chunks wherever they stand."""
        parts = text.split(self.special)
        found = list(map(self.__getitem__, _CHUNK.findall(parts[0])))
        for part in parts[1:]:
            found.append(self[self.special])
            found += map(self.__getitem__, _CHUNK.findall(part))
        return found


def spaced_parts(texts: pa.Array) -> tuple[pa.ListArray, pa.DictionaryArray]:
    """(the parts of each text between single spaces, the parts numbered): the costly half of tokens and of words alike."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
    return parts, parts.values.dictionary_encode()


def tokenize(texts: pa.Array, path: str, parts: tuple[pa.ListArray, pa.DictionaryArray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids with END, bounds by text) of a shard's texts; parts: their spaced_parts, if known.

    In almost all texts every single space starts a chunk: these are split and numbered by Arrow, and Python sees each
    distinct chunk once. The others are split by the pattern.
    """
    texts = pc.fill_null(texts, "")
    uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
    even = np.flatnonzero(~uneven)
    lists, coded = parts if parts is not None and not uneven.any() else spaced_parts(texts.take(pa.array(even)))
    bound = lists.offsets.to_numpy().astype(np.int64)
    spaced, of_even = len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
    other = Chunks(path)  # numbered after the chunks that follow a space
    first = bound[:-1]
    of_even[first] = [spaced + other[c] if c else -1 for c in lists.values.take(pa.array(first)).to_pylist()]
    others = [spaced + np.array(other.of(t), np.int64) for t in texts.filter(pa.array(uneven)).to_pylist()]
    size = np.zeros(len(texts), np.int64)
    size[even] = np.diff(bound)
    size[uneven] = [len(x) for x in others]
    at = np.append(0, np.cumsum(size))
    numbers = np.empty(at[-1], np.int64)
    numbers[np.repeat(at[even] - bound[:-1], size[even]) + np.arange(bound[-1])] = of_even
    for i, x in zip(np.flatnonzero(uneven).tolist(), others, strict=True):
        numbers[at[i] : at[i + 1]] = x
    own = numbers >= 0  # an empty text has no chunk
    at, numbers = np.append(0, np.cumsum(own))[at], numbers[own]

    flat, to = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
    for k in range(0, spaced, 50_000):  # chunks in a row: what is encoded is cut where each ends
        part = coded.dictionary.slice(k, 50_000)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")
        found = np.array(other.encode(" " + joined[0].as_py()), np.uint32)
        end = np.cumsum(pc.binary_length(part).to_numpy() + 1)
        to.append(to[-1][-1] + np.searchsorted(np.cumsum(other.size[found]), end, side="right"))
        flat.append(found)
    flat.append(np.fromiter(chain.from_iterable(other.ids), np.uint32))
    to.append(to[-1][-1] + np.cumsum([len(x) for x in other.ids], dtype=np.int64))
    ids, to = spread(np.concatenate(flat), np.concatenate(to), numbers)
    end = to[at[1:]]  # ids before the end of each text
    out = np.insert(ids, end, np.uint32(END))
    return out, np.append(0, end + np.arange(1, len(texts) + 1))


def word_numbers(texts: pa.Array, parts: tuple[pa.ListArray, pa.DictionaryArray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(numbers of the words, bounds by text, number of distinct words) of a shard's texts."""
    words, numbers, bound = _words(*(parts or spaced_parts(texts)))
    return numbers, bound, len(words)


class Bm25:
    """The inverted index of a shard: for each word the documents that hold it, with their weights."""

    def __init__(self, numbers: np.ndarray, bound: np.ndarray, n_words: int):
        n = len(bound) - 1
        pairs = [np.unique(numbers[a:b], return_counts=True) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
        self.words = [w for w, _ in pairs]
        size = np.fromiter(map(len, self.words), np.int64, n)
        length = np.diff(bound).astype(np.float64)
        word = np.concatenate([*self.words, np.empty(0, np.int64)])
        count = np.concatenate([*(c for _, c in pairs), np.empty(0, np.int64)]).astype(np.float64)
        doc = np.repeat(np.arange(n), size)
        self.df = np.bincount(word, minlength=n_words)
        idf = np.log1p((n - self.df + 0.5) / (self.df + 0.5))
        norm = K1 * (1 - B + B * length / max(1.0, length.mean() if n else 1.0))
        order = np.argsort(word, kind="stable")
        self.docs = doc[order]
        self.weight = (idf[word] * count * (K1 + 1) / (count + norm[doc]))[order]
        self.start = np.append(0, np.cumsum(self.df))

    def keep(self, kept: np.ndarray) -> None:
        """Takes the documents that are not kept out of the lists; the scores of the others, and their sums' order, stay."""
        mask = kept[self.docs]
        self.start = np.append(0, np.cumsum(mask))[self.start]
        self.docs, self.weight, self.df = self.docs[mask], self.weight[mask], np.diff(self.start)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all kept documents of the shard for all words of the seed."""
        words = self.words[seed]
        words = words[self.df[words] > 0]
        size = self.df[words]
        upto = np.cumsum(size)
        at = np.repeat(self.start[words] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)
        return np.bincount(self.docs[at], self.weight[at], len(self.words))


def pack_shard(lengths: list[int], neighbours, keep=None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset). neighbours(seed) scores the documents for a seed.

    keep, if given, is told which documents are still unused each time that their number has fallen by a fifth.
    """
    n, nxt = len(lengths), 0
    free, out, sequence, fill = np.ones(n, bool), [], 0, 0
    left, known = n, n  # unused documents, now and when keep was called
    seed, start = -1, 0  # the document that is being placed, and how much of it is
    scores = None
    while True:
        if seed < 0:
            if fill and scores is not None:
                best = int(scores.argmax())
                if scores[best] > 0:
                    seed, scores[best] = best, 0
                    if not free[seed]:
                        seed = -1
                        continue
            if seed < 0:
                while nxt < n and not free[nxt]:
                    nxt += 1
                if nxt == n:
                    break
                seed = nxt
            free[seed], start, left = False, 0, left - 1
        if not fill:
            scores = None
        take = min(lengths[seed] - start, WINDOW - fill)
        out.append((seed, start, take, sequence, fill))
        start, fill = start + take, fill + take
        if fill == WINDOW:
            sequence, fill, scores = sequence + 1, 0, None
        if start == lengths[seed]:
            if fill and scores is None:
                if keep and left < 0.8 * known:
                    keep(free)
                    known = left
                scores = np.where(free, neighbours(seed), 0)
            seed = -1
    if fill & (fill - 1):  # the last window: cut at powers of two
        tail = [x for x in out if x[3] == sequence]
        del out[len(out) - len(tail) :]
        sizes = [1 << b for b in range(WINDOW.bit_length() - 1, -1, -1) if fill >> b & 1]
        k = at = 0
        for doc, begin, size, _, _ in tail:
            while size:
                take = min(size, sizes[k] - at)
                out.append((doc, begin, take, sequence + k, at))
                begin, size, at = begin + take, size - take, at + take
                if at == sizes[k]:
                    k, at = k + 1, 0
    return out


def _shards(batches):
    """The shards of (doc_id, text, shard), sorted by shard; what came out larger than SHARD_BYTES is cut there."""
    held, size = [], 0
    for batch in batches:
        number = batch.column(2).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(edges):
            if a == b:
                continue
            if held and (held[-1].column(2)[0] != batch.column(2)[a] or size >= SHARD_BYTES):
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += batch.nbytes * (b - a) // batch.num_rows
    if held:
        yield pa.concat_batches(held)


def _packer(path: str):
    def run(batches):
        task, sequences = TaskContext.get(), 0
        base = (task.partitionId() if task else 0) << 40
        for shard in _shards(batches):
            parts = spaced_parts(shard.column(1))
            ids, to = tokenize(shard.column(1), path, parts)
            index = Bm25(*word_numbers(shard.column(1), parts))
            del parts
            total = np.diff(to)
            doc, start, size, sequence, offset = (np.array(x, np.int64) for x in zip(*pack_shard(total.tolist(), index.scores, index.keep), strict=True))
            names, begin, data = shard.column(0), to[doc] + start, ids.astype("<u4")
            for k in range(0, len(doc), 2048):
                at = slice(k, k + 2048)
                blob = pa.array([data[a : a + n].tobytes() for a, n in zip(begin[at].tolist(), size[at].tolist(), strict=True)], pa.binary())
                yield [names.take(pa.array(doc[at])), start[at], blob, total[doc[at]], base + sequences + sequence[at], offset[at]]
            sequences += int(sequence.max()) + 1

    return run


def min_hashes(texts: pa.Array) -> np.ndarray:
    """SORT_HASHES least hashes of each text's words, lower case; zeros without words. Each distinct word is hashed once."""
    words, numbers, bound = _words(*spaced_parts(texts))
    edges, data = (words.buffers()[i] for i in (1, 2))  # their bytes, without a string for each
    edges, data = np.frombuffer(edges, np.int32)[: len(words) + 1].tolist() if edges else [0], data.to_pybytes() if data else b""
    one = np.fromiter((xxhash.xxh64_intdigest(data[a:b]) for a, b in pairwise(edges)), np.uint64, len(words))
    full = np.flatnonzero(np.diff(bound))
    out = np.zeros((len(texts), SORT_HASHES), np.uint64)
    for k in range(SORT_HASHES if len(full) else 0):
        out[full, k] = np.minimum.reduceat((mix(one ^ np.uint64(k)) if k else one)[numbers], bound[:-1][full])
    return out


def _words(parts: pa.ListArray, coded: pa.DictionaryArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, their numbers in text order, bounds by text): words in lower case, between white space.

    Only the distinct spaced_parts are put in lower case and cut at other white space.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_lower(coded.dictionary))
    own = pc.greater(pc.binary_length(lists.values), 0)  # an empty part has no word
    edges = np.append(0, np.cumsum(own.to_numpy(zero_copy_only=False)))[lists.offsets.to_numpy()]
    words = lists.values.filter(own).dictionary_encode()
    numbers, bound = spread(words.indices.to_numpy().astype(np.int64), edges, coded.indices.to_numpy())
    return words.dictionary, numbers, bound[parts.offsets.to_numpy()]


def _hashed(batches):
    for batch in batches:
        yield [*batch.columns, *np.ascontiguousarray(min_hashes(batch.column(1)).view(np.int64).T)]


def in_shards(docs: DataFrame) -> DataFrame:
    """(doc_id, text, shard): docs(doc_id, text) dealt over shards, a few to a partition, related documents side by side.

    Where one shard ends and the next begins is read off a bounded sample of the documents, by a hash of id and text; every
    document is dealt, and goes where its min-hashes say.
    """
    names = [f"_h{k}" for k in range(SORT_HASHES)]
    kind = "doc_id long, text string, " + ", ".join(f"{n} long" for n in names)
    n = docs.count()
    part = min(max(SAMPLE, LEAST_SAMPLE / max(n, 1)), MOST_SAMPLE / max(n, 1), 1.0)
    place = [*names, "doc_id"]
    few = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(_HASHES)) < int(part * _HASHES)) if part < 1 else docs
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    # a row for each distinct document: repeated rows, however many, are one with their bytes
    seen = map_arrow(few, _hashed, kind).groupBy(*place).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n")).toPandas()
    seen = seen.sort_values(place, na_position="first")
    shards = min(MAX_SHARDS, max(1, -(-int(seen["size"].sum() / max(int(seen["n"].sum()), 1) * n) // SHARD_BYTES)))
    at = np.searchsorted(seen["size"].cumsum().to_numpy(), seen["size"].sum() * np.arange(1, shards) / shards)
    edges = _keys(*(seen[c].fillna(-(1 << 63)).to_numpy(np.int64)[at] for c in place))

    def deal(batches):
        for batch, columns in ((b, c) for b in batches for c in _hashed([b])):
            own = _keys(*columns[2:], batch.column(0).fill_null(-(1 << 63)).to_numpy())
            yield [*columns, np.searchsorted(edges, own, side="right").astype(np.int32)]

    parts = max(-(-shards // PER_PARTITION), min(shards, docs.sparkSession.sparkContext.defaultParallelism))
    dealt = map_arrow(docs, deal, kind + ", shard int").repartitionById(parts, F.expr(f"cast(cast(shard as bigint) * {parts} div {shards} as int)"))
    return dealt.sortWithinPartitions("shard", *place, F.xxhash64("text")).select("doc_id", "text", "shard")


def _keys(*columns: np.ndarray) -> np.ndarray:
    """Bytes that sort as the rows of signed numbers do."""
    flipped = np.stack([np.asarray(c, np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns], axis=1)
    return flipped.astype(">u8").view(f"S{8 * len(columns)}")[:, 0]


def pack(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, start, ids binary, doc_tokens, sequence_id, offset): the pieces of every row of docs(doc_id, text).

    ids are little-endian unsigned 32-bit; each document's end with END. Null and empty texts are END alone. Longer
    documents than WINDOW are cut, whatever their length. Repeated rows are packed each; null ids too. Equal scores go to
    the document that is earlier in the shard. An empty table gives no rows. Other columns, whatever their names, are not
    read. A sequence has at most WINDOW ids, gapless from offset 0.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(in_shards(plain), _packer(ranks_path or ranks_file()), "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def pieces(docs: DataFrame) -> DataFrame:
    """The pieces with length and checksum in place of the ids."""
    return pack(docs).select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 9 over the whole documents table."""
    return pieces(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of what is left. Odd rows are packed as pack says."""
    return pieces(docs)

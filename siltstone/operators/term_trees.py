"""Counts of phrases by group, shuffled as trees: what phrases of a block share at their beginning goes out once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from siltstone.functions.phrases import Places, places

#: Characters and texts whose phrases are counted at a time, and bytes of text for a bucket of phrases.
BLOCK_CHARS, BLOCK_TEXTS, BUCKET_BYTES = 8_000_000, 50_000, 4_000_000
_NAMES = ["bucket", "groups", "heads", "tree", "counts"]


def _unique(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an index of each different key, in their order; each key's number)."""
    order = np.argsort(key)
    new = np.diff(key[order], prepend=-1) != 0
    number = np.empty(len(order), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], number


def _numbered(key: np.ndarray, text: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an index of each different key, in their order; each key's number; how many texts have it at a good place)."""
    at, number = _unique(key)
    many = int(text.max(initial=0)) + 1
    own = np.sort(number[good] * np.int64(many) + text[good])  # np.unique would hash, in several times the time and memory
    return at, number, np.bincount(own[np.diff(own, prepend=-1) != 0] // many, minlength=len(at))


def _any(lists: list[np.ndarray], size: int) -> np.ndarray:
    """The places that are in any of the lists, in order."""
    found = np.zeros(size, bool)
    for p in lists:
        found[p] = True
    return np.flatnonzero(found)


def _hashes(values: pa.Array) -> np.ndarray:
    """A number for each value, the same in every process."""
    named = values.to_pylist() if pa.types.is_binary(values.type) else [repr(v).encode("utf-8", "surrogatepass") for v in values.to_pylist()]
    return np.fromiter(map(zlib.crc32, named), np.uint64, len(values))


def _mixed(*hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        total = (total ^ h) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def _heads(p: Places, unit: np.ndarray, group: np.ndarray, groups: pa.Array, good: list[np.ndarray], buckets: int) -> tuple[np.ndarray, ...]:
    """(bucket, group, first word, second word or -1, count, number of the place's pair) of single words and pairs of words.

    unit: by place, what counts once. The number is an array by place, for pairs that begin a phrase; it is the pair's index among the
    pairs, which follow the words.
    """
    words, word_hash, group_hash = np.int64(len(p.known) + 1), _hashes(p.known.cast(pa.binary())), _hashes(groups)
    one, pair = good[0], _any(good[1:], len(p.codes))
    base = group[p.text] * words + p.codes
    at, _, n1 = _numbered(base[one], unit[one], np.ones(len(one), bool))
    one = one[at]
    whole = np.zeros(len(p.codes), bool)
    whole[good[1]] = True
    at, number, n2 = _numbered(base[pair] * words + p.codes[pair + 1], unit[pair], whole[pair])
    own = np.zeros(len(p.codes), np.int32)
    own[pair] = number + len(one)
    pair = pair[at]
    g1, g2 = group[p.text[one]], group[p.text[pair]]
    bucket = np.concatenate([_mixed(group_hash[g1], word_hash[p.codes[one]]), _mixed(group_hash[g2], word_hash[p.codes[pair]], word_hash[p.codes[pair + 1]])])
    second = np.concatenate([np.full(len(one), -1), p.codes[pair + 1]])
    return (bucket % np.uint64(buckets)).astype(np.int64), np.concatenate([g1, g2]), p.codes[np.concatenate([one, pair])], second, np.concatenate([n1, n2]), own


def _trees(texts: list[str | None], group: np.ndarray, groups: pa.Array, inner: bool, compose: bool, buckets: int, each: bool = False) -> tuple[list, ...]:
    """The columns _NAMES, a row a bucket: its phrases by group as a tree in preorder.

    A node is its depth as a byte, 1 for a head (one or two words), and its word; each has the number of texts that have the phrase from
    the head down to it (each: how often they have it), 0 where that is none. heads: how many heads each group has.
    """
    p = places(texts, compose)
    good = [p.good(n, inner) for n in range(1, 5)]
    if not any(map(len, good)):
        return [], [], [], [], []
    unit = np.arange(len(p.codes)) if each else p.text
    bucket, owner, w1, w2, n_head, head = _heads(p, unit, group, groups, good, buckets)
    words = np.int64(len(p.known) + 1)
    three, four = _any(good[2:], len(p.codes)), good[3]
    whole = np.zeros(len(p.codes), bool)
    whole[good[2]] = True
    key = head[three] * words + p.codes[three + 2]
    at3, number, n3 = _numbered(key, unit[three], whole[three])
    third = np.zeros(len(p.codes), np.int32)
    third[three] = number
    at4, _, n4 = _numbered(third[four] * words + p.codes[four + 3], unit[four], np.ones(len(four), bool))
    three, four = three[at3], four[at4]
    # A node is sorted by its head's rank and its third word's number; heads come before thirds, thirds before fourths.
    ahead, below, w3, w4 = head[three], (head[four], third[four]), p.codes[three + 2], p.codes[four + 3]
    known, many = p.known, len(three) + 1
    del p, unit, good, key, number, whole, head, third, three, four, at3, at4
    order = np.lexsort((w2, w1, owner, bucket))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    key = np.concatenate([rank * many, rank[ahead] * many + 1 + np.arange(len(w3)), rank[below[0]] * many + 1 + below[1]])
    node = np.argsort(key, kind="stable")
    del key, rank, ahead, below
    depth = np.repeat(np.arange(3, dtype=np.int8), [len(order), len(w3), len(w4)])[node]
    take = lambda codes: known.take(pa.array(codes))
    single = w2 < 0
    pairs = pc.binary_join_element_wise(take(w1[~single]), take(w2[~single]), " ")
    text = pa.concat_arrays([x.cast(pa.string()) for x in (take(w1[single]), pairs, take(w3), take(w4))])
    text = pc.binary_join_element_wise(pa.array(["\1", "\2", "\3"]).take(pa.array(depth)), text.take(pa.array(node)), "")
    counts = np.concatenate([n_head, n3, n4])[node].astype("<i4")
    begin, data = np.frombuffer(text.buffers()[1], np.int32)[: len(text) + 1], text.buffers()[2]
    bucket, owner = bucket[order], owner[order]
    at = np.append(np.flatnonzero(depth == 0), len(node))
    found, runs = [], np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(runs, np.append(runs[1:], len(bucket)), strict=True):
        own, size = np.unique(owner[a:b], return_counts=True)
        i, j = at[a], at[b]
        found.append((bucket[a], groups.take(pa.array(own)), size.astype("<i4").tobytes(), pa.compress(data[begin[i] : begin[j]], "zstd", asbytes=True), pa.compress(counts[i:j].tobytes(), "zstd", asbytes=True)))
    return tuple(map(list, zip(*found, strict=True)))


def _sent(batches: Iterator[pa.RecordBatch], inner: bool, compose: bool, buckets: int, each: bool = False) -> Iterator[pa.RecordBatch]:
    """The trees of batches (group, text), block by block."""

    def trees() -> pa.RecordBatch:
        named = pa.concat_arrays(held).dictionary_encode("encode")
        cols = _trees(texts, named.indices.to_numpy().astype(np.int64), named.dictionary, inner, compose, buckets, each)
        size = np.cumsum([0, *map(len, cols[1])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(size), pa.concat_arrays([*cols[1], named.dictionary[:0]]))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), lists, *[pa.array(c, pa.binary()) for c in cols[2:]]], names=_NAMES)

    held, texts, chars = [], [], 0
    for batch in batches:
        begin = 0
        for i, t in enumerate(batch.column(1)):
            t = t.as_py()
            texts.append(t)
            chars += len(t or "") + 1
            if chars >= BLOCK_CHARS or len(texts) >= BLOCK_TEXTS:
                held.append(batch.column(0)[begin : i + 1])
                yield trees()
                begin, held, texts, chars = i + 1, [], [], 0
        held.append(batch.column(0)[begin:])
    if texts:
        yield trees()


def _opened(x: bytes) -> bytes:
    return pa.input_stream(pa.py_buffer(x), compression="zstd").read()


def _nodes(tree: bytes) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(depths, words) of a tree's nodes."""
    data = np.frombuffer(tree, np.uint8)
    mark = data < 4
    at = np.flatnonzero(mark)
    begin = (np.append(at, len(data)) - np.arange(len(at) + 1)).astype(np.int32)
    return data[at], pa.StringArray.from_buffers(len(at), pa.py_buffer(begin), pa.py_buffer(data[~mark])).dictionary_encode()


def _merged(table: pa.Table, name: str, count: str = "df") -> pa.Table:
    """(group, term, count) of a bucket's trees; name, count: of the columns."""
    named = pc.list_flatten(table.column("groups")).combine_chunks().dictionary_encode("encode")
    heads = np.frombuffer(b"".join(table.column("heads").to_pylist()), "<i4")
    depth, text = zip(*[_nodes(_opened(x.as_py())) for x in table.column("tree")], strict=True)
    depth = np.concatenate(depth)
    text = pa.chunked_array(text).unify_dictionaries()
    code, known = np.concatenate([x.indices.to_numpy() for x in text.chunks]), text.chunk(0).dictionary
    counts = np.concatenate([np.frombuffer(_opened(x.as_py()), "<i4") for x in table.column("counts")])
    words = np.int64(len(known) + 1)
    found, base = [], np.repeat(named.indices.to_numpy(), heads)
    for d in (1, 2, 3):
        at = np.flatnonzero(depth == d)
        first, number = _unique(base * words + code[at])
        own = known.take(pa.array(code[at[first]]))
        up = base[first]
        term, group = (own, up) if d == 1 else (pc.binary_join_element_wise(term.take(pa.array(up)), own, " "), group[up])
        df = np.bincount(number, counts[at], len(first)).astype(np.int64)
        keep = pa.array(df > 0)
        found.append(pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(group).filter(keep)), term.filter(keep), pa.array(df).filter(keep)], names=[name, "term", count]))
        if d < 3:  # what stands above each node of the next depth: the last node at this one before it
            base = number[(np.cumsum(depth == d, dtype=np.int32) - 1)[depth == d + 1]]
    return pa.Table.from_batches(found)


def _by_trees(df: DataFrame, group_col: str, text_col: str, inner: bool, compose: bool, count: str, each: bool) -> DataFrame:
    """(group, term, count). Each block's phrases become trees, dealt over buckets by group and first two words; a bucket's trees are merged by
    one call, and there are buckets enough that each holds the phrases of BUCKET_BYTES of text, but for a group's phrases with one beginning,
    which stay together.
    """
    spark = df.sparkSession
    rows = df.select(group_col, text_col)
    size = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    kind = rows.schema[0].dataType
    sent = StructType([StructField("bucket", IntegerType()), StructField("groups", ArrayType(kind)), *[StructField(x, BinaryType()) for x in _NAMES[2:]]])
    found = StructType([StructField(group_col, kind), *StructType.fromDDL(f"term string, {count} long").fields])
    trees = rows.mapInArrow(lambda batches: _sent(batches, inner, compose, buckets, each), sent)
    return trees.groupBy("bucket").applyInArrow(lambda table: _merged(table, group_col, count), found)


def document_frequencies(df: DataFrame, group_col: str, text_col: str, inner_stopwords: bool = True, compose: bool = True) -> DataFrame:
    """(group, term, df): how many texts of a group have each phrase; rows with a null group are one group."""
    return _by_trees(df, group_col, text_col, inner_stopwords, compose, "df", False)


def occurrences(df: DataFrame, group_col: str, text_col: str, inner_stopwords: bool = True, compose: bool = True) -> DataFrame:
    """(group, term, n): how often the texts of a group have each phrase; rows with a null group are one group."""
    return _by_trees(df, group_col, text_col, inner_stopwords, compose, "n", True)

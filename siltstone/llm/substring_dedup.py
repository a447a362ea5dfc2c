"""Removal of repeated passages by difference-cover anchors.

A window is WINDOW consecutive words. A window is repeated if its word sequence also starts earlier, and every word that a
repeated window covers goes. Hashing and shuffling every window is avoided: COVER is a difference cover modulo PERIOD, so
two equal windows, wherever they start, share an offset below PERIOD at which both have an anchor of ANCHOR words at a
cover position. Only anchors are shuffled. An anchor met twice is then extended to the windows around it, and only these
are compared in full.

A window stands for its words by 95 bits, of two independent hashes of each word: among 10**13 windows one false match is to
be expected in a thousand runs.

A place is a start in a text of a document: (doc, slot, start). The slot is 0 but for documents without an id and ids of
which there are several texts: there it is a hash of the text, so that each text has places of its own.

Each task first settles what it can among the documents of a block: of equal anchors or windows of a block only the
earliest goes on as a contender for the hash, so a passage that a third of all documents share has a row a block, not a
row a document, wherever rows of one hash meet. Blocks travel as compressed arrays by hash bucket.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import DOCUMENT_COLUMNS, cut, map_arrow, mix, pair_hash, table, words

WINDOW, ANCHOR, PERIOD, COVER = 20, 8, 13, (0, 1, 3, 9)
#: Anchors or windows of a block.
BLOCK = 500_000
#: Bytes of text whose anchors a bucket holds, at most and on average: what a task joins grows no further with the corpus.
BUCKET_BYTES = 64_000_000
#: Seed of the hashes of words that the further bits of a window come from.
OTHER = 1
#: Stands for a null doc_id: before every other one. No document may have this id.
NO_ID = -(1 << 63)
#: Ids with several texts that are sent to every task, at most; more of them are joined.
FEW_IDS = 100_000

_COVERED = np.isin(np.arange(PERIOD), COVER)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _hashes(tokens: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, tokens) if not seed else (digest(t, seed) for t in tokens), np.uint64, len(tokens))


def _grams(one: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size (8 or 20) words, from the hashes of the words."""
    two = pair_hash(one[:-1], one[1:])
    four = pair_hash(two[:-2], two[2:])
    eight = pair_hash(four[:-4], four[4:])
    if size == ANCHOR:
        return eight
    sixteen = pair_hash(eight[:-8], eight[8:])
    return pair_hash(sixteen[:-4], four[16:])


def anchor_positions(n_words: int) -> np.ndarray:
    """Starts of the anchors of a text of n_words words; none where no window fits."""
    at = np.arange(n_words - ANCHOR + 1 if n_words >= WINDOW else 0)
    return at[_COVERED[at % PERIOD]]


def windows_near(anchors: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the windows that hold one of the given anchors at an offset below PERIOD."""
    marks = np.zeros(n_words + 1, np.int64)
    marks[anchors[anchors < n_words] + 1] = 1
    total = np.cumsum(marks)
    n = n_words - WINDOW + 1
    return np.flatnonzero(total[PERIOD : PERIOD + n] > total[:n])


def _first(h: np.ndarray, place: tuple, more: np.ndarray | None = None):
    """(order by hash and place, row that begins each run of a hash, its index for every row) of a block.

    place: (doc, slot, start); more: further bits of the hash.
    """
    doc, slot, pos = place
    order = np.lexsort((pos, slot, doc, h) if more is None else (pos, slot, doc, more, h))
    new = np.ones(len(h), bool)
    new[1:] = np.diff(h[order].view(np.int64)) != 0
    if more is not None:
        new[1:] |= more[order][1:] != more[order][:-1]
    return order, new, np.flatnonzero(new)[np.cumsum(new) - 1]


def _later(place: tuple, start: np.ndarray) -> np.ndarray:
    """Which places, in the order of _first, are others than the first of their run."""
    return np.logical_or.reduce([x != x[start] for x in place])


def _spread(doc: np.ndarray, slot: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A hash for rows that need no partner: few values, yet over all partitions."""
    return mix((doc ^ slot).view(np.uint64) * np.uint64(31) + pos.astype(np.uint64)) & np.uint64(0xFFFE)


#: Bytes of each column of a blob's rows; columns of zeros take next to nothing.
_WIDTHS = (8, 8, 8, 4, 4)
_KINDS = (np.uint64, np.int64, np.int64, np.int32, np.uint32)


def pack(h: np.ndarray, place: tuple, more: np.ndarray | None, buckets: int):
    """(bucket, blob) columns: rows dealt by hash to buckets, each bucket's rows sorted and compressed by byte planes."""
    more = np.zeros(len(h), np.uint32) if more is None else more
    bucket = ((h >> np.uint64(1)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((h, bucket))
    h, doc, slot, pos, more, bucket = (x[order] for x in (h, *place, more, bucket))
    edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    squeeze, blobs = zstandard.ZstdCompressor(level=1), []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        columns = (np.diff(h[a:b], prepend=np.uint64(0)), doc[a:b], slot[a:b], pos[a:b], more[a:b])
        blobs.append(squeeze.compress(b"".join(x.view(np.uint8).reshape(-1, w).T.tobytes() for x, w in zip(columns, _WIDTHS, strict=True))))
    return [bucket[edge[:-1]], pa.array(blobs, pa.binary())]


def unpack(blob: bytes):
    """(h, doc, slot, start, more) of a blob."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, out = len(data) // sum(_WIDTHS), 0, []
    for width, kind in zip(_WIDTHS, _KINDS, strict=True):
        out.append(np.ascontiguousarray(data[at * n : (at + width) * n].reshape(width, n).T).view(kind)[:, 0])
        at += width
    return np.cumsum(out[0], dtype=np.uint64), *out[1:]


def _blocks(found, buckets: int, settle):
    """Packs what found yields, (hashes, further bits or none, doc, slot, starts) by document, in bounded blocks."""
    hs, mores, docs, slots, ats, held = [], [], [], [], [], 0

    def block():
        more = [] if mores[0] is None else [np.concatenate(mores)]
        place = tuple(np.concatenate(x) for x in (docs, slots, ats))
        return pack(*settle(np.concatenate(hs) & np.uint64(0xFFFFFFFFFFFFFFFE), place, *more), buckets)

    for h, more, doc, slot, at in found:
        hs.append(h)
        mores.append(more)
        docs.append(np.full(len(at), doc, np.int64))
        slots.append(np.full(len(at), slot, np.int64))
        ats.append(at.astype(np.int32))
        held += len(at)
        if held >= BLOCK:
            yield block()
            hs, mores, docs, slots, ats, held = [], [], [], [], [], 0
    if held:
        yield block()


def _settle_anchors(h, place):
    """Bit 0 of the hash is set where the block itself repeats the anchor; one row of each hash goes on as contender."""
    order, new, start = _first(h, place)
    h, place = h[order], tuple(x[order] for x in place)
    known = np.bincount(start, minlength=len(h))[start] > 1
    return np.where(known & ~new, _spread(*place), h) | known.astype(np.uint64), place, None


def _settle_windows(h, place, more):
    """Bit 0 of the hash is set where the block has an earlier equal window; the others go on as contenders."""
    order, _, start = _first(h, place, more)
    h, more, place = h[order], more[order], tuple(x[order] for x in place)
    late = _later(place, start)
    return np.where(late, _spread(*place) | np.uint64(1), h), place, np.where(late, np.uint32(0), more)


def _anchors(buckets: int):
    def found(batches):
        for batch in batches:
            for doc, slot, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens = words(text.as_py())
                at = anchor_positions(len(tokens))
                if len(at):
                    yield _grams(_hashes(tokens), ANCHOR)[at], None, doc, slot, at

    return lambda batches: _blocks(found(batches), buckets, _settle_anchors)


def _windows(buckets: int):
    def found(batches):
        for batch in batches:
            for doc, slot, text, anchors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                tokens = words(text.as_py())
                if len(tokens) < WINDOW:
                    continue
                at = windows_near(anchors.values.to_numpy(), len(tokens))
                if len(at):
                    yield _grams(_hashes(tokens), WINDOW)[at], (_grams(_hashes(tokens, OTHER), WINDOW)[at] >> np.uint64(32)).astype(np.uint32), doc, slot, at

    return lambda batches: _blocks(found(batches), buckets, _settle_windows)


def _met(h, doc, slot, pos, _):
    """Places of the anchors that are known to be repeated or that another contender repeats."""
    known = (h & np.uint64(1)).astype(bool)
    _, at, size = np.unique(h >> np.uint64(1), return_inverse=True, return_counts=True)
    # a contender that its own block repeats has bit 0 set, others of its hash may not: all meet here
    keep = known | (size[at] > 1)
    return doc[keep], slot[keep], pos[keep]


def _late(h, doc, slot, pos, more):
    """Places of the windows that are known to be repeated or that an earlier contender precedes."""
    known = (h & np.uint64(1)).astype(bool)
    place = tuple(x[~known] for x in (doc, slot, pos))
    order, _, start = _first(h[~known], place, more[~known])
    place = tuple(x[order] for x in place)
    late = _later(place, start)
    return tuple(np.concatenate([x[known], y[late]]) for x, y in zip((doc, slot, pos), place, strict=True))


def _whole(batches, parts):
    """For (bucket, blob) sorted by bucket: the joined arrays of each bucket."""
    now, blobs = None, []
    rows = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1), strict=True))
    for bucket, blob in chain(rows, [(None, None)]):
        if bucket != now and blobs:
            yield [np.concatenate(x) for x in zip(*map(parts, blobs), strict=True)]
            blobs = []
        now = bucket
        if blob is not None:
            blobs.append(blob.as_py())


def _places(solve, buckets: int):
    """The places that solve picks from each whole bucket, packed by text."""

    def block(found):
        place = tuple(map(np.concatenate, zip(*found, strict=True)))
        return pack(mix((place[0] ^ place[1]).view(np.uint64)) << np.uint64(1), place, None, buckets)

    def run(batches):
        found, held = [], 0
        for arrays in _whole(batches, unpack):
            found.append(solve(*arrays))
            held += len(found[-1][0])
            if held >= BLOCK:
                yield block(found)
                found, held = [], 0
        if held:
            yield block(found)

    return run


def _lists(batches):
    """(doc, slot, starts): one row a text."""
    for _, doc, slot, at, _ in _whole(batches, unpack):
        order = np.lexsort((slot, doc))
        doc, slot, at = doc[order], slot[order], at[order]
        edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (slot[1:] != slot[:-1])]))
        yield [doc[edge], slot[edge], pa.ListArray.from_arrays(pa.array(np.append(edge, len(doc)), pa.int32()), pa.array(at, pa.int32()))]


def covered_words(starts: np.ndarray, n_words: int) -> np.ndarray:
    """Which words the windows at starts cover."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    return np.cumsum(step)[:n_words] > 0


def _trim(text: str, gone: np.ndarray) -> str:
    """The text without the words that are gone and without the white space after each."""
    data = text.encode("utf-8", "surrogatepass")
    start = np.fromiter((m.start() for m in _WORD.finditer(data)), np.int64, len(gone))
    begin, out, at = np.append(start, len(data)), [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out.append(data[at : begin[a]])
        at = begin[b]
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def _kept(batches):
    """(doc, text, n_words, n_removed, kept, trimmed) of every row."""
    for batch in batches:
        out = [[], [], [], []]
        for text, places in zip(batch.column(1), batch.column(2), strict=True):
            text = text.as_py()
            tokens = words(text)
            n, gone = len(tokens), 0
            kept, trimmed = None, text
            if places.is_valid and n:
                at = places.values.to_numpy()
                mask = covered_words(at[at <= n - WINDOW], n)
                gone = int(mask.sum())
                if gone:
                    kept = b" ".join([t for t, m in zip(tokens, mask.tolist(), strict=True) if not m])
                    trimmed = _trim(text, mask)
            out[0].append(n)
            out[1].append(gone)
            out[2].append(b" ".join(tokens) if kept is None else kept)
            out[3].append(trimmed)
        yield [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.string())]


def placed(docs: DataFrame) -> tuple[DataFrame, int]:
    """(docs with doc and slot, bytes of all texts): which document and which of its texts each row of docs(doc_id, text) is.

    Rows of one id and one text are the same text. Which ids have several is found by the least and greatest hash of each
    id's texts; they are sent to every task if they are few, else joined. All rows without an id are told apart by text.
    """
    plain = docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    ids = cut(plain.groupBy("doc").agg(F.min(text).alias("low"), F.max(text).alias("high"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes")).select("doc", (F.col("low") != F.col("high")).alias("several"), "bytes"))
    size, n = ids.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.count_if("several"), F.lit(0))).first()
    several = ids.where(F.col("several") & (F.col("doc") != NO_ID)).select("doc", "several")
    if n:
        plain = plain.join(F.broadcast(several) if n <= FEW_IDS else several, "doc", "left")
        return plain.withColumn("slot", F.when(F.col("several") | F.col("doc_id").isNull(), text).otherwise(F.lit(0).cast("long"))).drop("several"), size
    return plain.withColumn("slot", F.lit(0).cast("long")), size


def repeated_windows(docs: DataFrame, size: int) -> DataFrame:
    """(doc, slot, places array<int>): starts of the repeated windows; docs has doc, slot (no nulls) and text, of size bytes."""
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (2 * BUCKET_BYTES)))

    def sent(df: DataFrame, function) -> DataFrame:
        return map_arrow(df, function, "bucket int, blob binary").repartition("bucket").sortWithinPartitions("bucket")

    def gathered(dealt: DataFrame, solve, name: str) -> DataFrame:
        return map_arrow(sent(dealt, _places(solve, buckets)), _lists, "doc long, slot long, at array<int>").withColumnRenamed("at", name)

    texts = docs.select("doc", "slot", "text")
    repeated = gathered(sent(texts, _anchors(2 * buckets)), _met, "anchors")
    near = texts.join(repeated.hint("shuffle_hash"), ["doc", "slot"]).select("doc", "slot", "text", "anchors")
    return gathered(sent(near, _windows(2 * buckets)), _late, "places")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept binary, text) for every row of docs(doc_id, text).

    kept: the words that stay, joined by one space (UTF-8); text: the text without the words that go, white space around
    the others unchanged. Windows are judged on the input. Null and empty texts have no words; texts of under WINDOW words
    stay whole; texts may have any length. Repeated rows, of one doc_id and one text, are one document and all stay as one
    would. Texts that differ are documents of their own, also where they share a doc_id or have none: those of an id are in
    the order of a hash of the text, and those without an id come before all others. So a row loses only words that one of
    its own repeated windows covers. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    plain, size = placed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    plain = plain.select("doc", "slot", "text")  # the columns that repeated_windows deals by text: dealt once for both
    both = plain.join(repeated_windows(plain, size).hint("shuffle_hash"), ["doc", "slot"], "left").select("doc", "text", "places")
    out = map_arrow(both, _kept, "doc long, n_words long, n_removed long, kept binary, text string")
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept", "text")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 1 over the whole documents table."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its repeated passages go; n_chars is that of what is left.

    Odd rows are treated as remove_repeats says; a text that loses nothing keeps its n_chars, whatever it says.
    """
    plain, size = placed(docs.select(*DOCUMENT_COLUMNS))
    both = plain.join(repeated_windows(plain, size).hint("shuffle_hash"), ["doc", "slot"], "left").select("doc_id", "text", "places", "lang", "source", "n_chars")

    def run(batches):
        for batch in batches:
            for out in _kept([batch]):
                yield [out[0], out[4], batch.column(3), batch.column(4), batch.column(5), out[2]]

    out = map_arrow(both, run, "doc_id long, text string, lang string, source string, n_chars long, gone long")
    return out.withColumn("n_chars", F.when(F.col("gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS p FROM w WHERE len(ws) >= {WINDOW}),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(ws[p:p + {WINDOW - 1}], ' ') ORDER BY doc_id, p) AS k FROM starts) WHERE k > 1),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
marked AS (SELECT d.doc_id, i, word, bool_or(l.p IS NOT NULL) OVER (PARTITION BY d.doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM words d LEFT JOIN late l ON l.doc_id = d.doc_id AND l.p = d.i),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

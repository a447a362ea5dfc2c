"""WARC archives: writing with payload deduplication, and reading by boundary-chain verification.

Writing: records of equal payloads are one response, that of the largest page_id, and revisits that refer to it. Digests
and the choice are DataFrame functions; each task deals its records to archives of bounded bytes, and a text writer whose
line separator is the record separator writes these, gzipped. Pages are read twice: for the digests that several of them
have, and to be written.

Reading: a task takes whole archives, looks for the record magic everywhere in one, payloads included, and notes for each
candidate its offset and the offset where its successor has to begin by its content length. Starting at the beginning of
the file, pointer jumping along these links keeps the records that can be reached, so that a record pasted into a payload
is dropped: no chain from the start leads to it. Only records that stay are digested, and archives are read once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import cut, map_arrow, remove, shared_dir, table

MAGIC = b"WARC/1.0\r\n"
#: Bytes of an archive before it is packed, at most; one record where that is larger.
ARCHIVE_BYTES = 64_000_000
#: Digests of several pages that are sent to every task, at most; more of them are joined, with the pages dealt by digest.
FEW_SHARED = 200_000
#: Records that a task hands on at a time.
STEP = 256
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0

_FIELD = re.compile(rb"\r\n([A-Za-z-]+): *([^\r\n]*)")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of a string's SHA-1: 20 bits at a time."""
    digits = F.sha1(F.encode(payload, "UTF-8"))
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame) -> DataFrame:
    """(value, size): one WARC record, without the separator, and its payload's bytes, for every row of pages(page_id, url, html).

    A null html is an empty payload, a null url an empty one; line ends within a url become a space; urls and payloads may
    have any length. A null page_id counts as less than every other; a group of such rows alone is all responses. Repeated
    rows are records of their own: those with the largest page_id of their payload are responses. An empty table gives no
    rows. Other columns, whatever their names, are not read.
    """
    line = "\r\n"
    p = pages.select(F.col("page_id").cast("long"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]+", " ").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", base32_sha1(F.col("html"))).withColumn("size", F.octet_length("html"))
    shared = cut(p.where(F.col("size") >= LEAST_BYTES).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keeper"))
    p = p.join(F.broadcast(shared) if shared.count() <= FEW_SHARED else shared, "digest", "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull(), F.lit(False)))
    name = lambda c: F.concat(F.lit("<urn:siltstone:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + line + "Content-Type: text/html; charset=utf-8" + line + "Content-Length: "), F.col("size"), F.lit(line * 2))
    head = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit(line + "WARC-Record-ID: "), name(F.col("page_id")),
        F.lit(line + "WARC-Target-URI: "), F.col("url"),
        F.lit(line + "WARC-Date: 1970-01-01T00:00:00Z" + line + "WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("revisit"), F.concat(F.lit(line + "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" + line + "WARC-Refers-To: "), name(F.col("keeper")))).otherwise(""),
        F.lit(line + "Content-Type: application/http;msgtype=response" + line + "Content-Length: "), F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("size")),
        F.lit(line * 2), http,
    )
    return p.select(F.when(F.col("revisit"), head).otherwise(F.concat(head, F.col("html"))).alias("value"), "size")


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes pages as gzipped WARC archives under path, each of the records of one task and at most ARCHIVE_BYTES."""
    most = ARCHIVE_BYTES

    def deal(batches):
        archive = held = 0
        for batch in batches:
            numbers = []
            for size in pc.binary_length(batch.column(0)).to_pylist():
                if held and held + size > most:
                    archive, held = archive + 1, 0
                held += size
                numbers.append(archive)
            yield [batch.column(0), numbers]

    found = map_arrow(records(pages).select("value"), deal, "value string, archive int")
    found.write.partitionBy("archive").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def candidates(data: bytes):
    """(offset, successor, header, block bounds) of everything in an archive that looks like a record.

    A header may have any length. Magics before the same header end share its fields, which are parsed once.
    """
    at, end, lines, size = data.find(MAGIC), -1, [], (-1, b"")
    while at >= 0:
        top = at + len(MAGIC) - 2
        if end < at:
            end = data.find(b"\r\n\r\n", at)
            if end < 0:
                return
            lines = [(m.start(), m[1].lower(), m[2]) for m in _FIELD.finditer(data, top, end)]
            size = next(((place, value) for place, name, value in reversed(lines) if name == b"content-length"), (-1, b""))
        if size[0] >= top and size[1].isdigit():
            begin, stop = end + 4, end + 4 + int(size[1])
            if data[stop : stop + 4] == b"\r\n\r\n":
                yield at, stop + 4, {name: value for place, name, value in lines if place >= top}, (begin, stop)
        at = data.find(MAGIC, at + 1)


def reachable(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates, sorted by offset, a chain from offset 0 reaches: pointer jumping, log2(n) rounds."""
    n = len(offset)
    to = np.searchsorted(offset, successor)
    to = np.where((to < n) & (offset[np.minimum(to, n - 1)] == successor), to, n)  # n: the end
    to = np.append(to, n)
    seen = np.zeros(n + 1, bool)
    seen[0] = n > 0 and offset[0] == 0
    for _ in range(max(1, n).bit_length()):
        seen[to[seen]] = True
        to = to[to]
    return seen[:n]


_READ = "path string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def inflate(data: bytes) -> bytes:
    """All members of a gzip file in a row."""
    parts = []
    while data:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data))
        data = member.unused_data
    return b"".join(parts)


def _scan(with_payload: bool, whole: bool):
    def number(name: bytes | None):
        found = (name or b"").rpartition(b":")[2].rstrip(b">")
        return int(found) if re.fullmatch(rb"-?\d+", found) else None

    def row(path, data, at, successor, fields, begin, stop):
        body = data.find(b"\r\n\r\n", begin, stop) + 4
        kind, digest = fields.get(b"warc-type", b"").decode(), fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
        payload = data[body:stop]
        inner = re.search(rb"\r\nContent-Length: (\d+)\r\n", data[begin:body])
        size = int(inner[1]) if kind == "revisit" and inner else len(payload)
        own = digest if kind == "revisit" else base64.b32encode(hashlib.sha1(payload).digest()).decode()
        return (path, at, number(fields.get(b"warc-record-id")), fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), kind, size, own, number(fields.get(b"warc-refers-to")), *([payload] * with_payload))

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = inflate(content.as_py()) if path.endswith(".gz") else content.as_py()
                found = list(candidates(data))
                offset, successor = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
                keep = np.flatnonzero(reachable(offset, successor)).tolist()
                end = int(successor[keep].max(initial=0))
                if whole and end != len(data):
                    raise ValueError(f"{path}: the chain of records stops at {end} of {len(data)} bytes")
                for k in range(0, len(keep), STEP):
                    rows = [row(path, data, *found[i][:3], *found[i][3]) for i in keep[k : k + STEP]]
                    yield [list(c) for c in zip(*rows, strict=True)]

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = False, whole: bool = False) -> DataFrame:
    """The records of the archives under path: _READ columns, with payload (binary) if asked for.

    payload_bytes and payload_digest are of what was read; for revisits as their headers say. A file whose chain breaks
    gives the records before the break; a file that doesn't start with a record gives none; no files give no rows.
    With whole, a file whose chain stops before its end is an error. Headers and payloads may have any length.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gz,warc,txt}").load(path).select("path", "content")
    return map_arrow(files, _scan(with_payload, whole), _READ + (", payload binary" if with_payload else ""))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 4 over the whole pages table."""
    return archived(table(spark, sf_dir, "pages"))


def archived(pages: DataFrame) -> DataFrame:
    """What is read back of pages that are written to archives in the shared folder; the archives go when they are read."""
    spark = pages.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    try:
        write_warc(pages, at)
        return cut(read_warc(spark, at, whole=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    finally:
        remove(spark, at)


def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table with a copy of every page under a larger page_id: each page revisits its copy."""
    pages = table(spark, sf_dir, "pages")
    return archived(pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1_000_000_000)))


_BITS = "array_to_string(list_transform(string_split(sha1(html), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', c)]), '')"
_FIVE = " + ".join(f"CAST(substr(bits, 5 * i + {k + 1}, 1) AS BIGINT) * {16 >> k}" for k in range(5))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, {_BITS} AS bits, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM d
"""
REVISITS_SQL = ORACLE_SQL.replace("FROM pages)", "FROM (SELECT page_id, html FROM pages UNION ALL SELECT page_id + 1000000000, html FROM pages))")

"""Pages over HTTP: hosts are dealt to tasks, each host is asked politely by one of them."""

from __future__ import annotations

import gzip
import ipaddress
import time
from collections.abc import Iterable, Iterator
from functools import cache
from http.client import HTTPException
from socket import timeout as SocketTimeout
from urllib.error import HTTPError, URLError
from urllib.parse import urljoin, urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.constants import BASE_DELAY_MS, BLOCKED_IPV4, BLOCKED_IPV6, DEFAULT_DELAY_MS, MAX_ATTEMPTS, MAX_REDIRECTS, MAX_RETRY_AFTER_MS, RETRY_STATUSES, SAMPLE_SIZE
from siltstone.functions.urls import host
from siltstone.sources.sitemap import SitemapReader

HTML_BYTES, TIMEOUT_S = 5_000_000, 15.0
SITEMAP_BYTES, SITEMAP_TIMEOUT_S, CHUNK = 50_000_000, 60.0, 1 << 16
KIND = pa.schema([("url", pa.string()), ("final_url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("x_robots", pa.string()), ("mitigated", pa.string()), ("body", pa.binary()), ("elapsed_ms", pa.int32()), ("error", pa.string())])
DDL = "url string, final_url string, status int, content_type string, x_robots string, mitigated string, body binary, elapsed_ms int, error string"


#: What a task holds back of its answers: so many rows, bytes of bodies and seconds, at most.
BATCH_ROWS, BATCH_BYTES, BATCH_S = 1_000, 4_000_000, 1.0
_BLOCKED = [ipaddress.ip_network(f"{a}/{p}") for a, p in BLOCKED_IPV4 + BLOCKED_IPV6]


class FetchError(Exception):
    """A failure with one of the crawl's codes."""


class _Stay(HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


@cache
def _opener():
    """One opener a process: each new one reads the certificates of the system again."""
    return build_opener(_Stay)


def check_target(url: str, allow_private: bool) -> None:
    """Raises for URLs that aren't http(s), carry credentials, or lead to other ports or addresses that aren't public."""
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError as error:
        raise FetchError("invalid_url") from error
    if parts.scheme not in ("http", "https") or not parts.hostname or parts.username or parts.password:
        raise FetchError("invalid_url")
    if allow_private:
        return
    if port not in (None, 80, 443):
        raise FetchError("blocked_host")
    import socket

    try:
        found = {ipaddress.ip_address(x[4][0].split("%")[0]) for x in socket.getaddrinfo(parts.hostname, port or 80, proto=socket.IPPROTO_TCP)}
    except OSError as error:
        raise FetchError("site_unreachable") from error
    for address in found:
        address = getattr(address, "ipv4_mapped", None) or address
        if any(address in net for net in _BLOCKED):
            raise FetchError("blocked_host")


def _read(answer, packed: bool, limit: int, until: float, take) -> bytes:
    """The body, unpacked, of at most limit bytes; with take, its parts are handed on instead, as long as it wants them."""
    stream, parts, size = gzip.GzipFile(fileobj=answer) if packed else answer, [], 0
    try:
        while part := stream.read(CHUNK):
            size += len(part)
            if size > limit:
                raise FetchError("too_large")
            if time.monotonic() > until:
                raise FetchError("timeout")
            if take is None:
                parts.append(part)
            elif not take(part):
                break
    except (OSError, EOFError, HTTPException) as error:
        raise FetchError("timeout" if isinstance(error, TimeoutError) else "site_unreachable") from error
    return b"".join(parts)


def _open(url: str, accept: str, limit: int, timeout: float, allow_private: bool, take=None) -> dict:
    until = time.monotonic() + timeout
    for _ in range(MAX_REDIRECTS + 1):
        check_target(url, allow_private)
        try:
            answer = _opener().open(Request(url, headers={"Accept": accept, "User-Agent": "siltstone"}), timeout=timeout)
        except HTTPError as error:
            answer = error
        except (TimeoutError, SocketTimeout) as error:
            raise FetchError("timeout") from error
        except (URLError, HTTPException, OSError) as error:
            raise FetchError("timeout" if isinstance(getattr(error, "reason", None), TimeoutError) else "site_unreachable") from error
        with answer:
            to = answer.headers.get("Location")
            if answer.status in (301, 302, 303, 307, 308) and to:
                url = urljoin(url, to)
                continue
            kind = answer.headers.get("Content-Type") or ""
            packed = "gzip" in kind.lower() or urlsplit(url).path.endswith(".gz") or answer.headers.get("Content-Encoding") == "gzip"
            body = _read(answer, packed, limit, until, take if answer.status == 200 else None)
            return {"final_url": url, "status": answer.status, "content_type": kind, "x_robots": answer.headers.get("X-Robots-Tag"), "mitigated": answer.headers.get("cf-mitigated"), "retry_after": answer.headers.get("Retry-After"), "body": body}
    raise FetchError("too_many_redirects")


def fetch(url: str, accept: str = "text/html,*/*;q=0.5", limit: int = HTML_BYTES, timeout: float = TIMEOUT_S, allow_private: bool = False, base_delay_ms: float = BASE_DELAY_MS, begin=lambda: None) -> dict:
    """The answer to a request, with retries of busy statuses, timeouts and unreachable sites; an error code instead of a raise.

    begin is called before each attempt and may return a function that takes the body as it comes.
    """
    began = time.monotonic()
    for attempt in range(1, MAX_ATTEMPTS + 1):
        pause = base_delay_ms * 2 ** (attempt - 1)
        try:
            got = _open(url, accept, limit, timeout, allow_private, begin()) | {"error": None}
            if got["status"] not in RETRY_STATUSES:
                break
            asked = (got["retry_after"] or "").strip()
            pause = min(float(asked) * 1000, MAX_RETRY_AFTER_MS) if asked.replace(".", "", 1).isdigit() else pause
        except FetchError as error:
            got = {"error": str(error)}
            if str(error) not in ("timeout", "site_unreachable"):
                break
        if attempt < MAX_ATTEMPTS:
            time.sleep(pause / 1000)
    got.pop("retry_after", None)
    return got | {"url": url, "elapsed_ms": round((time.monotonic() - began) * 1000)}


def sitemap_rows(site: str | None, url: str | None, most: int = SAMPLE_SIZE, limit: int = SITEMAP_BYTES, timeout: float = SITEMAP_TIMEOUT_S, allow_private: bool = False, base_delay_ms: float = BASE_DELAY_MS) -> list[dict]:
    """(site, sitemap_url, kind, ord, loc) of one sitemap, read as it comes and left as soon as there are most locations."""
    readers = []

    def begin():
        readers.append(SitemapReader(most))
        return readers[-1].feed

    got = fetch(url or "", accept="application/xml,text/xml;q=0.9,text/plain;q=0.8,*/*;q=0.5", limit=limit, timeout=timeout, allow_private=allow_private, base_delay_ms=base_delay_ms, begin=begin)
    if got.get("status") != 200 or got["error"]:
        return []
    if readers[-1].whole:
        readers[-1].feed(b"", True)
    form, found, _ = readers[-1].result()
    rows = [{"site": site, "sitemap_url": url, "kind": form, "ord": i, "loc": x} for i, x in enumerate(found)] or [{"site": site, "sitemap_url": url, "kind": form}]
    return rows if form != "unknown" else []


def fetch_sitemaps(urls: DataFrame, most: int = SAMPLE_SIZE, allow_private: bool = False, base_delay_ms: float = BASE_DELAY_MS) -> DataFrame:
    """(site, sitemap_url, kind, ord, loc) of the sitemaps at urls(site, sitemap_url) that can be read.

    A sitemap is read as it comes and left as soon as there are most locations; one may be large and slow. One without
    locations is a row whose ord and loc are null; what isn't there, or no sitemap, has no row.
    """
    kind = pa.schema([("site", pa.string()), ("sitemap_url", pa.string()), ("kind", pa.string()), ("ord", pa.int32()), ("loc", pa.string())])

    def run(batches):
        for batch in batches:
            for site, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pylist(sitemap_rows(site, url, most, allow_private=allow_private, base_delay_ms=base_delay_ms), schema=kind)

    dealt = urls.select("site", "sitemap_url").repartition(F.coalesce(host(F.col("sitemap_url")), F.lit("")))
    return dealt.mapInArrow(run, "site string, sitemap_url string, kind string, ord int, loc string")


def answer_batches(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    """Answers in batches of KIND, bounded in rows, bytes and seconds: a batch a row costs more than a target refused."""
    held, size, since = [], 0, time.monotonic()
    for row in rows:
        held.append({k: row.get(k) for k in KIND.names})
        size += len(row.get("body") or b"")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES or time.monotonic() - since >= BATCH_S:
            yield pa.RecordBatch.from_pylist(held, schema=KIND)
            held, size, since = [], 0, time.monotonic()
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=KIND)


def fetch_pages(urls: DataFrame, partitions: int | None = None, delay_ms: float = DEFAULT_DELAY_MS, limit: int = HTML_BYTES, timeout: float = TIMEOUT_S, allow_private: bool = False, base_delay_ms: float = BASE_DELAY_MS) -> DataFrame:
    """The answer for each of urls(url): one row a URL, an error code where there is none.

    URLs of a host are asked by one task, one after another with a pause between; hosts go on side by side.
    """

    def answers(batches):
        last: dict[str, float] = {}
        for batch in batches:
            for url in batch.column(0).to_pylist():
                name = urlsplit(url or "").netloc
                wait = last.get(name, 0) + delay_ms / 1000 - time.monotonic()
                if name in last and wait > 0:
                    time.sleep(wait)
                row = fetch(url or "", limit=limit, timeout=timeout, allow_private=allow_private, base_delay_ms=base_delay_ms)
                last[name] = time.monotonic()
                yield row

    def run(batches):
        return answer_batches(answers(batches))

    key = F.coalesce(host(F.col("url")), F.lit(""))
    dealt = urls.select("url").repartition(partitions, key) if partitions else urls.select("url").repartition(key)
    return dealt.mapInArrow(run, DDL)

"""HTTP as a data source: spark.read.format("http_pages") and spark.read.format("http_sitemaps"), after register(spark).

Options, all but one of the first two optional:

* list: a folder or file of Parquet with the URLs (and, for sitemaps, their sites), as write_url_list writes it: all URLs
  of a host in one file, hosts in turns. Each file is a partition; it is read by the task that asks for its URLs, so any
  number of URLs can be listed and none of them passes through the driver;
* urls: a JSON list of URLs, for a few of them; a partition a host;
* delayMs: the pause between two requests to a host (500); baseDelayMs: the first pause before a retry;
* limit, timeout: bytes and seconds of an answer; most: the locations after which a sitemap is left;
* allowPrivate: whether private addresses may be asked (false; for tests).

A partition asks its hosts in turns: while one host has its pause, the next one is asked. Busy statuses, timeouts and
unreachable sites are tried again; a target that may not be asked and a request that fails for good are rows with an error.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.functions.constants import BASE_DELAY_MS, DEFAULT_DELAY_MS, SAMPLE_SIZE
from siltstone.functions.urls import host
from siltstone.sources.http import DDL, HTML_BYTES, TIMEOUT_S, answer_batches, fetch, sitemap_rows

SITEMAP_DDL = "site string, sitemap_url string, kind string, ord int, loc string"
_SITEMAP_KIND = pa.schema([("site", pa.string()), ("sitemap_url", pa.string()), ("kind", pa.string()), ("ord", pa.int32()), ("loc", pa.string())])
#: URLs that are read from a list at a time.
LISTED = 10_000


def write_url_list(urls: DataFrame, path: str, files: int | None = None) -> None:
    """Writes urls(url[, site]) as a list: every host's in one file, within a file the first of each host, then the second.

    Repeated URLs are asked once a site; null URLs aren't listed.
    """
    rows = urls.select("url", *[c for c in urls.columns if c == "site"]).where("url is not null").distinct().withColumn("host", F.coalesce(host(F.col("url")), F.lit("")))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy(*[c for c in rows.columns if c != "host"])))
    dealt = rows.repartition(files, "host") if files else rows.repartition("host")
    dealt.sortWithinPartitions("turn", "host").drop("turn", "host").write.parquet(path)


class Listed(InputPartition):
    """A file of a list, or URLs themselves."""

    def __init__(self, path: str | None, urls: list[str]):
        super().__init__(path or urls)
        self.path, self.urls = path, urls


def _store(path: str):
    """(file system, path in it) of a URI or local path."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":  # file:/x, file:///x
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class HttpReader(DataSourceReader):
    def __init__(self, options: dict, answer, batches):
        self.options, self.answer, self.batches = {k.lower(): v for k, v in options.items()}, answer, batches
        if ("list" in self.options) == ("urls" in self.options):
            raise ValueError("one of the options list and urls is needed")

    def partitions(self) -> list[Listed]:
        if "urls" in self.options:
            hosts: dict[str, list[str]] = {}
            for url in dict.fromkeys(json.loads(self.options["urls"])):
                hosts.setdefault(_host(url), []).append(url)
            return [Listed(None, urls) for urls in hosts.values()] or [Listed(None, [])]
        from pyarrow import fs

        store, path = _store(self.options["list"])
        found = store.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["list"])
        files = [path] if found.type == fs.FileType.File else sorted(f.path for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.endswith(".parquet"))
        prefix = self.options["list"].split("://")[0] + "://" if "://" in self.options["list"] and not self.options["list"].startswith("file:") else ""
        return [Listed(prefix + f, []) for f in files] or [Listed(None, [])]

    def _rows(self, partition: Listed) -> Iterator[tuple[str | None, str]]:
        """(site, url) of a partition."""
        if partition.path is None:
            yield from ((None, url) for url in partition.urls)
            return
        import pyarrow.parquet as pq

        store, path = _store(partition.path)
        with store.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(LISTED):
                sites = batch.column("site").to_pylist() if "site" in batch.schema.names else [None] * batch.num_rows
                yield from zip(sites, batch.column("url").to_pylist(), strict=True)

    def read(self, partition: Listed) -> Iterator[pa.RecordBatch]:
        number = lambda name, other: float(self.options.get(name, other))
        pause, last = number("delayms", DEFAULT_DELAY_MS) / 1000, {}
        settings = {"base_delay_ms": number("basedelayms", BASE_DELAY_MS), "allow_private": str(self.options.get("allowprivate", "false")).lower() == "true"}
        for name, kind in (("limit", int), ("timeout", float), ("most", int)):
            if name in self.options:
                settings[name] = kind(self.options[name])

        def answers():
            for site, url in self._rows(partition):
                name = _host(url)
                wait = last.get(name, -pause) + pause - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                found = self.answer(site, url, settings)
                last[name] = time.monotonic()
                if found is not None:
                    yield found

        yield from self.batches(answers())


def _host(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def page_answer(site: str | None, url: str, settings: dict) -> dict:
    return fetch(url, **({"limit": HTML_BYTES, "timeout": TIMEOUT_S} | {k: v for k, v in settings.items() if k != "most"}))


def sitemap_answer(site: str | None, url: str, settings: dict) -> pa.RecordBatch | None:
    rows = sitemap_rows(site, url, **({"most": SAMPLE_SIZE} | settings))
    return pa.RecordBatch.from_pylist(rows, schema=_SITEMAP_KIND) if rows else None


class HttpPages(DataSource):
    """The answers to URLs: url, final_url, status, content_type, x_robots, mitigated, body, elapsed_ms, error."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(dict(self.options), page_answer, answer_batches)


class HttpSitemaps(DataSource):
    """The locations of sitemaps: site, sitemap_url, kind, ord, loc; see fetch_sitemaps."""

    @classmethod
    def name(cls) -> str:
        return "http_sitemaps"

    def schema(self) -> str:
        return SITEMAP_DDL

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(dict(self.options), sitemap_answer, iter)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    for source in (HttpPages, HttpSitemaps):
        spark.dataSource.register(source)

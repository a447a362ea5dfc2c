"""Sitemaps and robots.txt as sources: documents in, rows out, in Arrow batches with a lenient reader."""

from __future__ import annotations

import re
from codecs import getincrementaldecoder
from urllib.parse import quote, unquote, urlsplit
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.constants import SAMPLE_SIZE

_HTTP = re.compile(r"^https?://", re.IGNORECASE)
_ROOTS = {"sitemapindex": "index", "urlset": "urlset"}


class SitemapReader:
    """Reads a sitemap as its bytes come, up to a number of locations.

    The first visible character decides between XML and one URL a line. Broken XML keeps what was read before the break.
    """

    def __init__(self, most: int = SAMPLE_SIZE):
        self.most, self.kind, self.found, self.whole = most, None, [], True
        self.decode = getincrementaldecoder("utf-8")("replace").decode
        self.stack, self.text, self.held, self.parser = [], None, "", None

    def feed(self, data: bytes, last: bool = False) -> bool:
        """Takes the next bytes; False as soon as no more are wanted."""
        text = self.decode(data, last)
        if self.kind is None and self.parser is None:
            text = (self.held + text).removeprefix("\ufeff").lstrip()
            if text.startswith("<"):
                self.parser = expat.ParserCreate("utf-8")  # whatever the declaration says
                self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self._start, self._end, self._characters
            elif text:
                self.kind = "text"
            self.held = ""
        if self.parser is not None:
            self._xml(text, last)
        elif self.kind == "text":
            *lines, self.held = (self.held + text).split("\n")
            lines = [*lines, self.held] if last else lines
            self.found += [x for x in map(str.strip, lines) if _HTTP.match(x)]
            self.whole = len(self.found) <= self.most
        return self.whole

    def _xml(self, text: str, last: bool) -> None:
        try:
            self.parser.Parse(text, last)
        except expat.ExpatError:
            self.whole = False
        self.whole = self.whole and len(self.found) < self.most

    def _start(self, name, attrs):
        local = name.rpartition(":")[2].lower()
        if not self.stack:
            self.kind = _ROOTS.get(local, "unknown")
        self.text = "" if name == "loc" and self.stack and self.stack[-1] in ("url", "sitemap") else self.text
        self.stack.append(local)

    def _characters(self, content):
        if self.text is not None:
            self.text += content

    def _end(self, name):
        if self.stack.pop() == "loc" and self.text is not None:
            if value := self.text.strip():
                self.found.append(value)
            self.text = None

    def result(self) -> tuple[str, list[str], bool]:
        """(kind, locations, complete): index, urlset, text or unknown."""
        return self.kind or "unknown", self.found[: self.most], self.whole


def read_sitemap(content: bytes | str | None, most: int = SAMPLE_SIZE) -> tuple[str, list[str], bool]:
    """(kind, locations, complete) of a whole sitemap."""
    reader = SitemapReader(most)
    reader.feed(content.encode("utf-8", "replace") if isinstance(content, str) else content or b"", True)
    return reader.result()


def sitemap_urls(documents: DataFrame, most: int = SAMPLE_SIZE) -> DataFrame:
    """(site, sitemap_url, kind, ord, loc) of documents(site, sitemap_url, body string or binary).

    A document without locations is a row whose ord and loc are null.
    """
    kind = pa.schema([("site", pa.string()), ("sitemap_url", pa.string()), ("kind", pa.string()), ("ord", pa.int32()), ("loc", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for site, url, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                form, found, _ = read_sitemap(body, most)
                rows += [{"site": site, "sitemap_url": url, "kind": form, "ord": i, "loc": x} for i, x in enumerate(found)] or [{"site": site, "sitemap_url": url, "kind": form}]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return documents.select("site", "sitemap_url", "body").mapInArrow(run, "site string, sitemap_url string, kind string, ord int, loc string")


def parse_robots(text: str | None) -> tuple[list[dict], list[str]]:
    """(groups, sitemaps): groups as {agents, rules [(allow, path)], delay}."""
    groups, sitemaps, now, open_ = [], [], None, False
    for line in (text or "").splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "sitemap":
            sitemaps.append(value)
        elif name == "user-agent":
            if not open_:
                now = {"agents": [], "rules": [], "delay": None}
                groups.append(now)
            now["agents"].append(value.lower())
            open_ = True
        elif now is not None:
            open_ = False
            if name in ("allow", "disallow") and value:
                now["rules"].append((name == "allow", value))
            elif name == "crawl-delay":
                try:
                    now["delay"] = float(value)
                except ValueError:
                    pass
    return groups, sitemaps


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(site, sitemap_url, ord): the sitemaps that robots(site, status, content_type, robots) list, in order."""
    kind = pa.schema([("site", pa.string()), ("sitemap_url", pa.string()), ("ord", pa.int32())])

    def run(batches):
        for batch in batches:
            rows = [{"site": site, "sitemap_url": url, "ord": i} for site, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, url in enumerate(parse_robots(text)[1])]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return robots.select("site", _usable().alias("robots")).mapInArrow(run, "site string, sitemap_url string, ord int")


def _usable() -> Column:
    """The text of a robots.txt; none for a missing or HTML one."""
    return F.when((F.col("status") == 200) & ~F.lower(F.coalesce("content_type", F.lit(""))).contains("html"), F.col("robots")).otherwise("")


def _matches(rule: str, path: str) -> bool:
    pattern = "".join(".*" if c == "*" else re.escape(c) for c in quote(unquote(rule.removesuffix("$")), safe="/%*?=&:;,+@!~'()-._"))
    return re.match(pattern + ("$" if rule.endswith("$") else ""), path) is not None


def robots_verdict(groups: list[dict], agent: str, url: str) -> tuple[bool, float | None]:
    """(allowed, crawl delay) for an agent: its own groups, else those of *; the longest rule wins, of equals allow."""
    name = agent.lower()
    every = [g for g in groups if "*" in g["agents"]]
    own = [g for g in groups if any(a != "*" and a and a in name for a in g["agents"])] or every
    parts = urlsplit(url)
    path = quote(unquote(parts.path or "/"), safe="/%*?=&:;,+@!~'()-._") + (f"?{parts.query}" if parts.query else "")
    hits = [(len(rule), allow) for g in own for allow, rule in g["rules"] if _matches(rule, path)]
    return (max(hits)[1] if hits else True), next((g["delay"] for g in own + every if g["delay"] is not None), None)


def robots_check(urls: DataFrame, agent: str) -> DataFrame:
    """urls(url, status, content_type, robots) with allowed and crawl_delay; a missing or HTML robots.txt allows everything."""
    kind = pa.schema([("url", pa.string()), ("allowed", pa.bool_()), ("crawl_delay", pa.float64())])

    def run(batches):
        for batch in batches:
            rows, parsed = [], {}
            for url, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text not in parsed:
                    parsed = {text: parse_robots(text)[0]}  # rows of a site follow one another
                allowed, delay = robots_verdict(parsed[text], agent, url)
                rows.append({"url": url, "allowed": allowed, "crawl_delay": delay})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return urls.select("url", _usable().alias("robots")).mapInArrow(run, "url string, allowed boolean, crawl_delay double")

"""HTML as a source: facts of pages, by a lenient parser, and their anchors."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.constants import BLOCK_TAGS, NOISE_TAGS
from siltstone.functions.text import word_count

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes if it is still open.
_CLOSES = {t: {"p"} for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
_CLOSES |= {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "html", "nav", "header", "footer", "aside"}
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "tag", "up")

    def __init__(self, tag, attrs, up):
        self.tag, self.attrs, self.children, self.up = tag, attrs, [], up

    def walk(self):
        """This node and all below, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, drop=frozenset(), spaced=frozenset()) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x is self or x.tag not in drop:
                if x.tag in spaced and x is not self:
                    todo.append(" ")
                todo.extend(reversed(x.children))
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        close, node, last = _CLOSES.get(tag, ()), self.at, None
        while close and node.up is not None and (node.tag in close or node.tag not in _SCOPES):
            last = node if node.tag in close else last
            node = node.up
        if last is not None:
            self.at = last.up
        found = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(found)
        if tag not in _VOID:
            self.at = found

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.at
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def squeeze(text: str | None) -> str:
    return _SPACE.sub(" ", text or "").strip()


def json_ld_nodes(raw: str) -> list[dict]:
    """Objects of a JSON-LD text: one, a list, or those of a @graph; none where it is no JSON."""
    try:
        data = json.loads(raw)
    except ValueError:
        return []
    found = []
    for node in data if isinstance(data, list) else [data]:
        if isinstance(node, dict):
            graph = node.get("@graph")
            found += [x for x in graph if isinstance(x, dict)] if isinstance(graph, list) else [node]
    return found


def _strings(value) -> list[str]:
    return [value] if isinstance(value, str) else [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def facts_of(html: str | None, url: str | None, x_robots: str | None = None) -> dict:
    """What the rules and the phrase picks need of a page."""
    nodes = list(parse(html or "").walk())
    of = lambda *tags: [n for n in nodes if n.tag in tags]
    named = lambda tag, key, value: next((n for n in of(tag) if n.attrs.get(key, "").lower() == value), None)
    attr = lambda node, key: squeeze(node.attrs.get(key)) if node else ""
    titles = of("title")
    title = next((squeeze(n.text()) for n in titles if n.up.tag == "head"), "") or (squeeze(titles[0].text()) if titles else "")
    content = (of("article") or of("main") or of("body") or [nodes[0]])[0]
    main = squeeze(content.text(frozenset(NOISE_TAGS), frozenset(BLOCK_TAGS)))
    linked = [x for n in of("script") if n.attrs.get("type") == "application/ld+json" for x in json_ld_nodes(n.text())]
    images, html_tag = of("img"), of("html")
    insecure = [n for n in nodes if (n.tag in ("img", "script", "iframe") and n.attrs.get("src", "").startswith("http:")) or (n.tag == "link" and n.attrs.get("rel") == "stylesheet" and n.attrs.get("href", "").startswith("http:"))]
    return {
        "title": title or None,
        "meta_description": attr(named("meta", "name", "description"), "content") or None,
        "h1s": [t for n in of("h1") if (t := squeeze(n.text()))],
        "headings": [t for n in of("h2", "h3") if (t := squeeze(n.text()))],
        "canonical": attr(named("link", "rel", "canonical"), "href") or None,
        "robots": f"{attr(named('meta', 'name', 'robots'), 'content')},{x_robots or ''}".lower(),
        "lang": attr(html_tag[0] if html_tag else None, "lang") or None,
        "jsonld_types": [t for x in linked for t in _strings(x.get("@type"))],
        "jsonld_keywords": [k for x in linked for v in _strings(x.get("keywords")) for k in map(str.strip, v.split(",")) if k],
        "images_total": len(images),
        "images_missing_alt": [n.attrs.get("src", "(no src)") for n in images if "alt" not in n.attrs],
        "insecure_resources": len(insecure) if (url or "").startswith("https:") else 0,
        "main_text": main,
        "script_count": sum("src" in n.attrs for n in of("script")),
    }


_TEXTS = pa.list_(pa.string())
_FACTS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("meta_description", pa.string()), ("h1s", _TEXTS), ("headings", _TEXTS),
    ("canonical", pa.string()), ("robots", pa.string()), ("lang", pa.string()), ("jsonld_types", _TEXTS), ("jsonld_keywords", _TEXTS), ("images_total", pa.int32()),
    ("images_missing_alt", _TEXTS), ("insecure_resources", pa.int32()), ("main_text", pa.string()), ("script_count", pa.int32()),
])
_FACTS_DDL = "page_id long, url string, title string, meta_description string, h1s array<string>, headings array<string>, canonical string, robots string, lang string, jsonld_types array<string>, jsonld_keywords array<string>, images_total int, images_missing_alt array<string>, insecure_resources int, main_text string, script_count int"


def page_facts(pages: DataFrame) -> DataFrame:
    """One row of facts for each row of pages(page_id, url, html[, x_robots]), by the lenient parser in Arrow batches."""
    x_robots = F.col("x_robots").cast("string") if "x_robots" in pages.columns else F.lit(None).cast("string")

    def run(batches):
        for batch in batches:
            rows = [{"page_id": i, "url": u} | facts_of(h, u, r) for i, u, h, r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=_FACTS)

    found = pages.select(F.col("page_id").cast("long"), "url", "html", x_robots).mapInArrow(run, _FACTS_DDL)
    return found.withColumn("word_count", word_count(F.col("main_text")))


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, ord, href, text, in_nav) for every link of pages(page_id, url, html), in document order."""
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("ord", pa.int32()), ("href", pa.string()), ("text", pa.string()), ("in_nav", pa.bool_())])

    def in_nav(node: Node) -> bool:
        while node is not None:
            if node.tag in ("header", "nav"):
                return True
            node = node.up
        return False

    def run(batches):
        for batch in batches:
            rows = []
            for i, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                links = [n for n in parse(h or "").walk() if n.tag == "a" and "href" in n.attrs]
                rows += [{"page_id": i, "url": u, "ord": k, "href": n.attrs["href"], "text": squeeze(n.text()).lower(), "in_nav": in_nav(n)} for k, n in enumerate(links)]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, ord int, href string, text string, in_nav boolean")

"""URL expressions: site keys, normal forms, path shapes and sitemap names. Paths are lower case where they are compared."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.constants import ARCHIVE_SEGMENTS, GENERIC_NAME_WORDS, NEGATIVE_TOKENS, POSITIVE_TOKENS

# Patterns of tracking parameters, of language and region segments, and of files that are no pages.
TRACKING = r"(?i)^(utm_[a-z]+|gclid|fbclid|mc_cid|mc_eid|ref)(=|$)"
LOCALE = r"^[a-z]{2}(-[a-z]{2,4})?$"
NON_HTML = r"(?i)\.(pdf|jpe?g|png|gif|webp|svg|zip|mp4|mp3|xml|json|css|js|txt)$"


def host(url: Column) -> Column:
    """Host of an absolute http(s) URL, without port and credentials, lower case; null for other texts."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1)), F.lit(""))


def site_key(hostname: Column) -> Column:
    """A host without a leading www. and a trailing dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(hostname), r"^www\.", ""), r"\.$", "")


def path(url: Column) -> Column:
    """Path of an absolute URL, lower case; "/" where there is none, "" for texts that are no URL."""
    found = F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    return F.when(host(url).isNull(), "").when(found == "", "/").otherwise(F.lower(found))


def strip_hash(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def ascii_url(url: Column) -> Column:
    """An http(s) URL in ASCII: its host by IDNA, other characters percent-encoded; ASCII URLs stay as they are."""
    part = lambda i: F.regexp_extract(url, r"(?is)^(https?://(?:[^/?#@]*@)?)([^/?#:]*)(.*)$", i)
    quoted = F.transform(F.split(part(3), ""), lambda c: F.when(c.rlike(r"^[\x21-\x7E]*$"), c).when(c == " ", "%20").otherwise(F.url_encode(c)))
    whole = F.concat(part(1), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), part(2)), F.array_join(quoted, ""))
    return F.when(url.rlike(r"^[\x21-\x7E]*$"), url).otherwise(whole)


def strip_default_port(origin: Column) -> Column:
    """A scheme and authority without the port that goes without saying."""
    return F.regexp_replace(origin, r"(?i)^(http)(://.*):80$|^(https)(://.*):443$", "$1$3$2$4")


def normalize_page_url(url: Column, base: Column | None = None) -> Column:
    """An http(s) URL without fragment, default port and tracking parameters, in ASCII, scheme and host in lower case; else null.

    With base a relative reference is resolved against it (Python); otherwise it gives null.
    """
    plain = ascii_url(strip_hash(F.trim(resolve(url, base) if base is not None else url)))
    head = F.substring_index(plain, "?", 1)
    query = F.when(F.instr(plain, "?") > 0, F.substr(plain, F.length(head) + 2))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(TRACKING)), "&")
    origin = strip_default_port(F.lower(F.regexp_extract(head, r"^[^:]+://[^/]+", 0)))
    whole = F.concat(origin, F.when(F.regexp_extract(head, r"^[^:]+://[^/]+(.*)$", 1) == "", "/").otherwise(F.regexp_extract(head, r"^[^:]+://[^/]+(.*)$", 1)))
    port = F.coalesce(F.nullif(F.regexp_extract(origin, r":(\d+)$", 1), F.lit("")).cast("long"), F.lit(0))
    return F.when(host(plain).isNotNull() & (port < 65536), F.when(query.isNull() | (kept == "") | kept.isNull(), whole).otherwise(F.concat(whole, F.lit("?"), kept)))


def _join(href: str | None, base: str | None, web: bool) -> str | None:
    if href is None or base is None:
        return None
    try:
        found = urljoin(base, href.strip())
        parts = urlsplit(found)
        parts.port  # noqa: B018  raises for a port that is none
    except ValueError:
        return None
    if parts.scheme not in ("http", "https"):
        return found if parts.scheme and not web else None
    if not parts.hostname:
        return None
    return found if parts.path else found.replace(parts.netloc, parts.netloc + "/", 1)


@F.pandas_udf(T.StringType())
def resolve(href: pd.Series, base: pd.Series) -> pd.Series:
    """A possibly relative reference against its page's URL; null where it gives no http(s) URL. Spark has no resolver."""
    return pd.Series([_join(h, b, True) for h, b in zip(href, base, strict=True)])


@F.pandas_udf(T.StringType())
def resolve_any(href: pd.Series, base: pd.Series) -> pd.Series:
    """The same for references of any scheme."""
    return pd.Series([_join(h, b, False) for h, b in zip(href, base, strict=True)])


def parse_website(url: Column) -> Column:
    """struct<url, origin, site_key> of a website as a person enters it; null if it is not an http(s) URL of a named host."""
    plain = ascii_url(F.substring_index(strip_hash(F.trim(url)), "?", 1))
    good = plain.rlike(r"(?i)^https?://[^/?#@\s]+") & ~plain.rlike(r"^[^:]+://[^/]*@") & (F.contains(host(plain), F.lit(".")) | plain.rlike(r"(?i)^https?://\["))
    origin = F.lower(strip_default_port(F.regexp_extract(plain, r"(?i)^https?://[^/]+", 0)))
    rest = F.regexp_extract(plain, r"(?i)^https?://[^/]+(.*)$", 1)
    return F.when(good, F.struct(F.concat(origin, F.when(rest == "", "/").otherwise(rest)).alias("url"), origin.alias("origin"), site_key(host(plain)).alias("site_key")))


def is_subdomain(hostname: Column, site: Column) -> Column:
    """Whether a host is below a site, www. apart."""
    h, s = F.lower(hostname), site_key(site)
    return (h != s) & (h != F.concat(F.lit("www."), s)) & F.endswith(h, F.concat(F.lit("."), s))


def is_under(p: Column, hub: Column) -> Column:
    """Whether a path is a hub's or below it."""
    base = F.when(F.endswith(hub, F.lit("/")), hub).otherwise(F.concat(hub, F.lit("/")))
    return (p == hub) | F.startswith(p, base)


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: s != "")


def is_article_shaped(p: Column) -> Column:
    """1 to 4 segments, of which the last has two hyphens or underscores, or a year and month among them."""
    s = segments(p)
    return F.coalesce(F.size(s).between(1, 4) & ((F.regexp_count(F.element_at(s, -1), F.lit("[-_]")) >= 2) | p.rlike(r"/\d{4}/\d{2}/")), F.lit(False))


def is_archive_or_file(p: Column) -> Column:
    """Listings, further pages of listings, and files other than HTML."""
    return F.arrays_overlap(segments(p), F.array(*map(F.lit, ARCHIVE_SEGMENTS))) | p.rlike(r"/page/\d+/?$") | p.rlike(NON_HTML)


def family_key(url: Column) -> Column:
    """A sitemap's URL without the number before its extension."""
    return F.regexp_replace(url, r"(?i)\d+(?=(\.xml)?(\.gz)?/?$)", "")


def name_tokens(url: Column) -> Column:
    """Words of a sitemap's file name; of its whole path where the name says nothing."""
    words = lambda t: F.filter(F.split(t, "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(GENERIC_NAME_WORDS) & ~w.rlike(r"^\d+$"))
    s = segments(path(url))
    own = words(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit("")))
    return F.when(F.size(own) > 0, own).otherwise(words(F.array_join(s, "/")))


def has_positive(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, POSITIVE_TOKENS)))


def has_negative(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, NEGATIVE_TOKENS)))


def has_locale(p: Column) -> Column:
    return F.exists(F.split(p, "/"), lambda s: s.rlike(LOCALE))


def slug_text(url: Column) -> Column:
    """The last path segment as words: decoded, without extension, hyphens and underscores as spaces; '' if it can't be."""
    raw = F.regexp_extract(strip_hash(url), r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    last = F.coalesce(F.try_element_at(segments(raw), F.lit(-1)), F.lit(""))
    decoded = F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))  # a plus is no space in a path
    return F.coalesce(F.regexp_replace(F.regexp_replace(decoded, r"(?i)\.[a-z]+$", ""), "[-_]+", " "), F.lit(""))

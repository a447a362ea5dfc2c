"""Text expressions: white space, words, titles, hashes and random draws, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.constants import CRAWL_ERRORS, SOURCE_LABELS

# What a word is, and what parts a title from the name of its site.
WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
SITE_NAME = r"(?U)\s+[|•·–—-]\s+"


def collapse(c: Column) -> Column:
    """White space runs, Unicode ones too, as one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def strip_site_name(title: Column) -> Column:
    """A title without its last part after a separator between spaces."""
    parts = F.split(title, SITE_NAME)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " ")).otherwise(title)


def site_name(title: Column) -> Column:
    """The last part of a title after a separator, lower case; null without one."""
    parts = F.split(title, SITE_NAME)
    return F.when(F.size(parts) > 1, non_empty(F.lower(F.trim(F.element_at(parts, -1)))))


def round2(c: Column) -> Column:
    """Two decimals, halves up."""
    return F.floor(c * 100 + 0.5) / 100


def normalize_email(c: Column) -> Column:
    return F.lower(F.trim(c))


def token_id(c: Column) -> Column:
    """The stored id of a session token."""
    return F.sha2(c, 256)


_MASK = 0xFFFFFFFF


def times32(a: Column, b: Column) -> Column:
    """Product modulo 2**32 of unsigned 32-bit numbers in longs; the upper half is multiplied apart to stay in 64 bits."""
    low, high = a.bitwiseAND(0xFFFF), F.shiftright(a, 16)
    return (low * b + F.shiftleft((high * b).bitwiseAND(0xFFFF), 16)).bitwiseAND(_MASK)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    codes = F.transform(units, lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, u: times32(h.bitwiseXOR(u), F.lit(0x01000193).cast("long")))


def let(value: Column, use) -> Column:
    """use(value) with value computed once: expressions within higher-order functions share nothing of their own."""
    return F.element_at(F.transform(F.array(value), use), 1)


def draw(seed: Column, k: Column) -> Column:
    """The k-th number (from 1) in [0, 1) of the additive 32-bit generator with this seed: its state is seed + k * step."""
    state = (seed + times32(k.cast("long"), F.lit(0x6D2B79F5).cast("long"))).bitwiseAND(_MASK)
    first = lambda s: let(times32(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(1)), second)
    second = lambda t: let((t + times32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(61))).bitwiseAND(_MASK).bitwiseXOR(t), third)
    third = lambda u: u.bitwiseXOR(F.shiftright(u, 14)) / F.lit(4294967296.0)
    return let(state, first)


def _lookup(table: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def crawl_error_text(code: Column) -> Column:
    """The plain reason of a failure code; null for codes that are none."""
    return _lookup(CRAWL_ERRORS, code)


def source_labels(sources: Column) -> Column:
    """The names under which a pick's sources are shown."""
    return F.transform(sources, lambda s: F.coalesce(_lookup(SOURCE_LABELS, s), s))

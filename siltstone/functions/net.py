"""What may be fetched, and how answers are treated: addresses, targets, retries, redirects, encodings."""

from __future__ import annotations

import ipaddress
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.constants import BASE_DELAY_MS, BLOCKED_IPV4, BLOCKED_IPV6, MAX_ATTEMPTS, MAX_REDIRECTS, MAX_RETRY_AFTER_MS, RETRY_STATUSES
from siltstone.functions.lineage import cut
from siltstone.functions.text import let

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def ipv4_number(c: Column) -> Column:
    """A dotted address as a number; null for other texts."""
    parts = F.split(c, r"\.")
    return F.when(c.rlike(_IPV4), reduce(lambda total, i: total * 256 + parts[i].cast("long"), range(4), F.lit(0).cast("long")))


def is_public_ipv4(c: Column) -> Column:
    """Whether an IPv4 address is outside all blocked ranges; null for other texts. Ranges are compared as numbers."""
    spans = [(int(net.network_address), int(net.broadcast_address)) for net in (ipaddress.ip_network(f"{a}/{p}") for a, p in BLOCKED_IPV4)]
    return let(ipv4_number(c), lambda n: ~reduce(lambda x, y: x | y, [n.between(a, b) for a, b in spans]))


@F.pandas_udf(T.BooleanType())
def _is_public_ipv6(values: pd.Series) -> pd.Series:
    blocked = [ipaddress.ip_network(f"{a}/{p}") for a, p in BLOCKED_IPV6]

    def one(x):
        try:
            address = ipaddress.IPv6Address(x)
        except (ValueError, TypeError):
            return False
        return not any(address in net for net in blocked)

    return values.map(one)


def is_public_address(c: Column) -> Column:
    """Whether a text is a public IP address; IPv6 with an IPv4 address within by that one; other texts are not."""
    mapped = F.regexp_extract(c, r"(?i)^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    v4 = F.when(mapped != "", mapped).otherwise(c)
    return F.when(v4.rlike(_IPV4), is_public_ipv4(v4)).when(mapped != "", False).when(F.contains(c, F.lit(":")), _is_public_ipv6(c)).otherwise(False)


def target_error(url: Column, allow_private: bool = False) -> Column:
    """Why a URL may not be fetched: invalid_url, blocked_host, or null if it may."""
    authority = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    port = F.regexp_extract(authority, r":(\d*)$", 1)
    hostname = F.regexp_replace(F.regexp_replace(authority, r":\d*$", ""), r"^\[|\]$", "")
    literal = hostname.rlike(_IPV4) | F.contains(hostname, F.lit(":"))
    invalid = ~url.rlike(r"(?i)^https?://[^/?#\s]+") | F.contains(authority, F.lit("@"))
    private = ~port.isin("", "80", "443") | (literal & ~is_public_address(hostname))
    return F.when(F.coalesce(invalid, F.lit(True)), "invalid_url").when(F.lit(not allow_private) & private, "blocked_host")


def retry_delay_ms(attempt: Column, retry_after: Column, random: Column) -> Column:
    """Pause before the next attempt: what the answer asks for, up to a limit, else a random part of a doubling base."""
    asked = F.when(retry_after.rlike(r"^\s*\d+(\.\d+)?\s*$"), F.trim(retry_after).cast("double"))
    base = F.lit(BASE_DELAY_MS) * F.pow(F.lit(2.0), attempt - 1)
    return F.when(asked.isNotNull(), F.least(asked * 1000, F.lit(float(MAX_RETRY_AFTER_MS)))).otherwise(base / 2 + random * base)


def should_retry(status: Column, error: Column, attempt: Column) -> Column:
    """Whether an attempt is followed by another: busy statuses, timeouts and unreachable sites, up to a number."""
    return (status.isin(RETRY_STATUSES) | error.isin("timeout", "site_unreachable")) & (attempt < MAX_ATTEMPTS)


def follow_redirects(urls: DataFrame, redirects: DataFrame, most: int = MAX_REDIRECTS) -> DataFrame:
    """(url, final_url, hops, error) of urls(url) over redirects(src, dst): hop by hop, each target checked.

    error: that of a forbidden target, or too_many_redirects beyond the limit. Redirects are joined by shuffle, whatever
    their estimated size: rows made from small columns look small, and a broadcast would pass through the driver.
    """
    at = urls.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"), target_error(F.col("url")).alias("error"))
    checked = cut(redirects.select(F.col("src").alias("final_url"), "dst", target_error(F.col("dst")).alias("dst_error"))).hint("merge")  # each target once
    for hop in range(most + 1):
        moved = at.join(checked, "final_url", "left").withColumn("go", F.col("dst").isNotNull() & F.col("error").isNull())
        if hop == most:
            return moved.select("url", "final_url", "hops", F.when(F.col("go"), "too_many_redirects").otherwise(F.col("error")).alias("error"))
        at = moved.select("url", F.when(F.col("go"), F.col("dst")).otherwise(F.col("final_url")).alias("final_url"), (F.col("hops") + F.col("go").cast("int")).alias("hops"), F.when(F.col("go"), F.col("dst_error")).otherwise(F.col("error")).alias("error"))
    return at


@F.pandas_udf(T.StringType())
def decode_body(body: pd.Series, content_type: pd.Series) -> pd.Series:
    """Bytes as text by the charset of the header, else of a meta tag within the first kilobyte, else UTF-8."""

    def one(data, kind):
        if data is None:
            return None
        data = bytes(data)
        found = re.search(r"charset=[\"']?([\w-]+)", kind or "", re.I) or re.search(r"<meta[^>]+charset=[\"']?([\w-]+)", data[:1024].decode("latin-1"), re.I)
        name = (found[1] if found else "utf-8").lower()
        name = "cp1252" if name in ("iso-8859-1", "latin1", "ascii", "us-ascii") else name  # as browsers read them
        try:
            return data.decode(name, "replace").removeprefix("﻿")
        except LookupError:
            return data.decode("utf-8", "replace").removeprefix("﻿")

    return pd.Series([one(b, k) for b, k in zip(body, content_type, strict=True)])

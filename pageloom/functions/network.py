"""Domains, addresses and client identities as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import matches, trimmed

# What a rejected submission is told.
DOMAIN_ERRORS = {
    "empty": "Enter a website domain to audit.",
    "long": "That domain is too long.",
    "scheme": "Only http(s) websites are supported - try a domain like example.com.",
    "shape": "That does not look like a valid domain. Try example.com.",
    "ip": "Enter a domain name (e.g. example.com), not an IP address.",
    "local": "Enter a public website domain (e.g. example.com).",
    "single": "Enter a full domain with an ending, like example.com.",
    "ending": "That domain ending doesn't look valid (try .com, .io, .org, …).",
}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"
_V4_TAIL = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\z"


def normalize_domains(df: DataFrame, column: str) -> DataFrame:
    """Adds ``ok, domain, root_url, error`` for user-entered sites; IDN input must already be punycode."""
    raw = trimmed(F.coalesce(F.col(column), F.lit("")))
    url = F.when(matches(raw, r"(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    authority = F.regexp_extract(url, r"(?i)^https?:/+([^/?#\\]*)", 1)
    no_user = F.regexp_replace(authority, r"^.*@", "")
    host = F.lower(F.regexp_replace(no_user, r"(?<=[^:\[]):\d{0,5}\z", ""))
    bare = F.regexp_replace(host, r"^www\.", "")
    bad_chars = matches(host, r"[^a-z0-9.\-_~!$&'()*+,;=:\[\]]") | (host == "")
    numeric_end = matches(host, r"(?:^|\.)\d+\.?\z")
    dotted = matches(host, r"^\d{1,3}(?:\.\d{1,3}){0,3}\z") & ~matches(host, r"(?:^|\.)(?:25[6-9]|2[6-9]\d|[3-9]\d\d)(?:\.|\z)")
    labels = F.split(bare, r"\.")
    ending = F.element_at(labels, -1)
    label_ok = F.forall(labels, lambda l: matches(l, r"^[a-z0-9-]{1,63}\z") & ~matches(l, r"^-|-\z"))
    local = (bare == "localhost") | matches(bare, r"\.(?:local|localhost|internal)\z")
    code = (
        F.when(raw == "", "empty")
        .when(F.length(raw) > 253, "long")
        .when(~matches(raw, r"(?i)^https?://") & matches(raw, r"(?i)^[a-z][a-z0-9+.-]*://"), "scheme")
        .when(bad_chars, "shape")
        .when(numeric_end & ~dotted, "shape")
        .when(numeric_end | F.contains(bare, F.lit(":")), "ip")
        .when(local, "local")
        .when(F.size(labels) < 2, "single")
        .when(~matches(ending, r"^[a-z]{2,}\z") & ~matches(ending, r"^xn--[a-z0-9]+\z"), "ending")
        .when(~label_ok, "shape")
    )
    error = F.lit(None).cast("string")
    for key, text in DOMAIN_ERRORS.items():
        error = F.when(F.col("_code") == key, text).otherwise(error)
    ok = F.col("_code").isNull()
    return (
        df.withColumns({"_code": code, "_bare": bare})
        .withColumns({
            "ok": ok,
            "domain": F.when(ok, F.col("_bare")),
            "root_url": F.when(ok, F.concat(F.lit("https://"), F.col("_bare"))),
            "error": error,
        })
        .drop("_code", "_bare")
    )


def _octets(ip: Column) -> Column:
    return F.transform(F.split(ip, r"\."), lambda p: p.try_cast("int"))


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value evaluated once, however often ``fn`` reads it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _v4_ranges(o: Column) -> Column:
    a, b = F.get(o, F.lit(0)), F.get(o, F.lit(1))
    return (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
    )


def _v4_private(ip: Column) -> Column:
    """Private, loopback, link-local, carrier, protocol, multicast and reserved ranges; malformed counts as private."""
    protocol = lambda o: (F.get(o, F.lit(0)) == 192) & (F.get(o, F.lit(1)) == 0) & (F.get(o, F.lit(2)) == 0)
    inside = _let(_octets(ip), lambda o: (F.array_max(o) > 255) | _v4_ranges(o) | protocol(o))
    return F.when(matches(ip, r"^\d{1,3}(?:\.\d{1,3}){3}\z"), inside).otherwise(True)


def _v6_valid(ip: Column) -> Column:
    flat = F.regexp_replace(ip, r"%[0-9a-z]+\z", "")
    flat = F.regexp_replace(flat, rf"{_OCTET}(?:\.{_OCTET}){{3}}\z", "0:0")
    groups = F.regexp_count(flat, F.lit(r"[0-9a-f]{1,4}"))
    shape = matches(flat, r"^(?:[0-9a-f]{1,4}|::|:)+\z") & ~matches(flat, r"[0-9a-f]{5}|:::|::.*::|^:[^:]|[^:]:\z")
    return shape & F.when(F.contains(flat, F.lit("::")), groups <= 7).otherwise(groups == 8)


def is_private_ip(address: Column) -> Column:
    """True unless the address is provably public; anything unreadable is unsafe."""
    ip = F.lower(address)
    tail = F.nullif(F.regexp_extract(ip, _V4_TAIL, 1), F.lit(""))
    v6 = (
        F.when(ip.isin("::1", "::"), True)
        .when(tail.isNotNull(), _v4_private(tail))
        .otherwise(matches(ip, r"^fe[89ab]|^f[cd]"))
    )
    return F.coalesce(F.when(matches(ip, _V4), _v4_private(ip)).when(_v6_valid(ip), v6), F.lit(True))


def refused_domains(addresses: DataFrame) -> DataFrame:
    """A domain is refused if any of its resolved addresses is private."""
    return addresses.groupBy("domain").agg(F.bool_or(is_private_ip(F.col("ip"))).alias("refused"))


def is_private_host(host: Column) -> Column:
    """Private by name or by literal address, for hosts that are never resolved."""
    h = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(host, F.lit("")), r":\d+\z", ""), r"\.\z", ""))
    h = F.regexp_replace(h, r"^\[|\]\z", "")
    test_net = lambda o: (F.get(o, F.lit(0)) == 192) & (F.get(o, F.lit(1)) == 0) & (F.get(o, F.lit(2)) == 2)
    blocked4 = _let(_octets(h), lambda o: (F.array_max(o) > 255) | _v4_ranges(o) | test_net(o))
    is_v4 = r"^\d{1,3}(?:\.\d{1,3}){3}\z"
    mapped = F.regexp_extract(h, r"^::ffff:(.*)\z", 1)
    return (
        F.when(h == "", True)
        .when((h == "localhost") | matches(h, r"\.(?:localhost|internal|local|lan|home\.arpa)\z"), True)
        .when(~F.contains(h, F.lit(".")) & ~F.contains(h, F.lit(":")), True)
        .when(matches(h, is_v4), blocked4)
        .when(matches(h, r"^::ffff:"), F.when(matches(mapped, is_v4), _v4_private(mapped)).otherwise(
            ~F.contains(mapped, F.lit("."))))
        .when(F.contains(h, F.lit(":")), h.isin("::1", "::") | matches(h, r"^f[cd][0-9a-f]{0,2}:|^fe[89ab][0-9a-f]:"))
        .otherwise(False)
    )


def client_address(headers: Column) -> Column:
    """First hop of the edge header, else of the forwarded header, else the real-ip header, else 'unknown'."""
    first = lambda name: F.nullif(F.try_element_at(headers, F.lit(name)), F.lit(""))
    hop = lambda v: trimmed(F.split_part(v, F.lit(","), F.lit(1)))
    return F.coalesce(hop(first("x-vercel-forwarded-for")), hop(first("x-forwarded-for")), first("x-real-ip"),
                      F.lit("unknown"))

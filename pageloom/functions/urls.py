"""URL columns: host, path, dedupe key, page kind, priority, sensitive paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import scrubbed

# Path rules, first match wins, then the priority of a path among the candidates of a site.
PAGE_KINDS = [
    ("homepage", r"^/?\z"),
    ("pricing", r"pricing|/plans|/price"),
    ("about", r"/(about|company|team)"),
    ("product", r"/(product|feature|solution|platform)"),
    ("blog", r"/(blog|news|article|post|guide)|/20\d\d/"),
    ("contact", r"/(contact|support|help|docs?)"),
]
PATH_PRIORITY = [
    (10, r"pricing|/plans|/price"),
    (8, r"/(product|feature|solution|platform)"),
    (6, r"/(about|company|team)"),
    (4, r"/(contact|services?)"),
    (-6, r"/(blog|news|article|post|tag|category)|/20\d\d/"),
]
# Path segments that are never audited.
SENSITIVE_SEGMENTS = [
    "wp-admin", "wp-login", "wp-json", "administrator", "admin", "login", "signin", "sign-in", "signup", "sign-up",
    "register", "accounts?", "dashboard", "customers?", "users?", "profile", "settings", "preferences", "checkout",
    "cart", "orders?", "invoices?", "preview", "drafts?", "staging", "stage", "dev", "test", "debug", "server-status",
    "phpmyadmin", r"\.git", r"\.env", r"\.well-known", "api", "graphql", "internal", "private", "backup", "tmp", "cache",
]
SENSITIVE_PATH = "(?i)/(?:" + "|".join(SENSITIVE_SEGMENTS) + r")(?:/|\z|\?|#)"


def host_of(u: Column) -> Column:
    """Host of an absolute URL, '' otherwise; ``www.`` is dropped before lower-casing."""
    return F.lower(F.regexp_replace(F.regexp_extract(u, r"(?i)^https?://([^/?#]+)", 1), r"^www\.", ""))


def path_of(u: Column) -> Column:
    """Path without query, fragment and trailing slashes; '/' for the root; other text is kept as it is."""
    inner = scrubbed(F.regexp_replace(F.regexp_extract(u, r"(?i)^https?://[^/]+(/[^?#]*)?", 1), r"/+\z", ""))
    plain = F.when(F.regexp_like(u, F.lit(r"(?i)^https?://[^/]+")), inner).otherwise(scrubbed(u))
    return F.when((plain == "") | plain.isNull(), F.lit("/")).otherwise(plain)


def dedupe_key(u: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(u, r"[#?].*\z", ""), r"/\z", "")


def after_origin(u: Column) -> Column:
    return F.regexp_replace(u, r"(?i)^https?://[^/]+", "")


def page_kind(u: Column) -> Column:
    path = F.lower(after_origin(F.coalesce(u, F.lit(""))))
    out = None
    for name, pattern in PAGE_KINDS:
        hit = F.regexp_like(path, F.lit(pattern))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def path_priority(u: Column) -> Column:
    path = F.lower(after_origin(u))
    score = F.lit(0)
    for points, pattern in PATH_PRIORITY:
        score = score + F.when(F.regexp_like(path, F.lit(pattern)), points).otherwise(0)
    return score - F.regexp_count(path, F.lit("[^/]+"))


def is_sensitive(u: Column) -> Column:
    return F.regexp_like(after_origin(u), F.lit(SENSITIVE_PATH))


def comparable(u: Column) -> Column:
    """Form in which a canonical target and the page's own URL are compared."""
    for pattern in (r"(?i)^https?://", r"(?i)^www\.", r"[#?].*\z", r"/+\z"):
        u = F.regexp_replace(u, pattern, "")
    return F.lower(u)


def resolved_canonical(href: Column, own: Column) -> Column:
    origin = F.regexp_extract(own, r"(?i)^https?://[^/]+", 0)
    return (
        F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .otherwise(href)
    )


def redacted(c: Column) -> Column:
    """Every URL in the text keeps scheme and host only; credentials go, path and query become a marker."""
    marked = F.regexp_replace(c, r"(?i)(https?://[^/?#\s\"')]+)[/?#][^\s\"')]*", "$1/[redacted]")
    return F.regexp_replace(marked, r"(?i)(https?://)[^@/\s?#\"')]*@", "$1")

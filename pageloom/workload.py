"""Audit inputs derived from the provided tables.

The raw ``pages`` are plain (no canonical, no tags, no schema markup) and the ``documents`` have no markup at all, so
most rules would give one answer everywhere. Here every row of both tables becomes a crawled page, decorated by its
own id with the markup the rules look for; per-site inputs are derived from the report ids. The decorations are plain
SQL expressions that Spark and a second engine read alike, so results can be compared row by row.

Nothing is filtered: the derived crawl has one row per page and one per document, and grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.sources.crawl import site_inputs

NL = "chr(10)"
LONG = "'" + " ".join(["Sites answer the question of the section heading in one plain sentence"] * 4) + ".'"


def _case(expr: str, branches: dict, default: str = "''") -> str:
    arms = " ".join(f"WHEN {k} THEN {v}" for k, v in branches.items())
    return f"(CASE {expr} {arms} ELSE {default} END)"


HOST = "lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www[.]', ''))"
_HEAD = " || ".join([
    _case("page_id % 6", {
        0: "'<link rel=\"canonical\" href=\"' || url || '\">'",
        1: "'<link href=\"/other/page\" rel=\"canonical\">'",
        2: f"'<link rel=\"canonical\" href=\"//' || {HOST} || '/x?y=1\">'"}),
    _case("page_id % 11", {
        0: "'<meta name=\"robots\" content=\"noindex,follow\">'",
        5: "'<META content=\"noindex\" name=\"googlebot\">'",
        7: "'<meta name=\"robots\" content=\"max-snippet: 0\">'"}),
    _case("page_id % 4", {
        0: "'<meta property=\"og:title\" content=\"t\">'",
        1: f"'<meta property=\"og:site_name\" content=\"' || {HOST} || '\">'"}),
    _case("page_id % 3", {0: "'<meta name=\"viewport\" content=\"width=device-width\">'"}),
    _case("page_id % 5", {0: "'<link rel=\"shortcut icon\" href=\"/f.ico\">'", 1: "'<link rel=\"icon\" href=\"/f.svg\">'"}),
    _case("page_id % 13", {
        0: "'<link rel=\"alternate\" hreflang=\"zh-Hant\" href=\"/zh\"><link rel=\"alternate\" hreflang=\"x-default\">'",
        1: "'<link rel=\"alternate\" hreflang=\"english_1\" href=\"/en\">'"}),
    _case("page_id % 7", {
        0: f"'<script type=\"application/ld+json\">{{\"@type\":\"Organization\",\"name\":\"' || {HOST} || '\","
           "\"sameAs\":[\"https://x.com/a\",\"https://y.com/b\"]}</script>'",
        1: "'<script type=\"application/ld+json\">{\"@type\": \"Article\",\"author\":\"A\",\"datePublished\":\"2023-06-01\"}"
           "</script>'",
        2: "'<script type=\"application/ld+json\">{\"@type\":\"Product\",\"offers\":[]}</script>'",
        3: "'<script type=\"application/ld+json\">{\"@type\":\"FAQPage\"}</script>'",
        4: "'<script type=\"application/ld+json\">{\"@type\":\"Organization\",\"name\":\"Other Brand\","
           "\"sameAs\":[\"https://en.wikipedia.org/wiki/A\"]}</script>'",
        5: "'<script type=\"application/ld+json\">{\"@type\":\"Thing\",\"sameAs\":[\"https://x.com/a\"]}</script>'"}),
    _case("page_id % 4", {
        0: "'<script src=\"/a.js\"></script>'", 1: "'<script defer src=\"/b.js\"></script>'",
        2: "'<script type=\"module\" src=\"/c.js\"></script>'"}),
    _case(f"length({HOST}) % 6", {
        0: "'<script>gtag(\"config\", \"G-ABCDEF1234\");dataLayer.push({});</script>'",
        1: "'<script src=\"https://www.googletagmanager.com/gtm.js?id=GTM-ABC123\" async></script>'",
        2: "'<script src=\"https://consent.cookiebot.com/uc.js\" async></script>"
           "<script>gtag(\"consent\",\"default\",{ad_user_data:1,ad_personalization:1})</script>"
           "<script async src=\"https://static.hotjar.com/c.js\"></script>'",
        3: "'<script async src=\"https://connect.facebook.net/fbevents.js\"></script>"
           "<script>ga(\"create\",\"UA-12345-1\")</script><script async src=\"https://www.clarity.ms/t\"></script>'"}),
])
_BODY = " || ".join([
    _case("page_id % 5", {
        0: "'<img src=\"/a.webp\" alt=\"x\" width=\"1\" height=\"2\" loading=\"lazy\"><img src=\"http://cdn.example/x.png\">'",
        1: "'<picture><img src=\"/b.avif\" style=\"aspect-ratio:1\"></picture><img alt=\"y\" src=\"/c.png\" width=\"3\">'",
        2: "'<img src=\"https://x.imgix.net/a.jpg\" alt=\"\">'"}),
    _case("page_id % 7", {
        0: "'<h3>skip</h3>'", 1: "'<h2>a</h2><h3>b</h3>'", 2: "'<h1>second</h1>'", 3: "'<h2 class=\"q\">a</h2><h5>b</h5>'"}),
    _case("page_id % 9", {
        0: "'<time datetime=\"2024-01-05\">Jan</time>'", 1: "'<time>sometime</time>'",
        2: "'<p>Last updated in spring</p>'", 3: "'<time datetime=\"not a date\">x</time>'",
        4: "'<time datetime=\"2023-03-01T10:30:00\">x</time>'"}),
    _case("page_id % 8", {0: "'<table><tr><td>1</td></tr></table>'", 1: "'<details><summary>Why so?</summary>x</details>'"}),
    _case("page_id % 10", {0: "'<style>b{background:url(http://cdn.example/b.png)}</style>'"}),
])

PAGE_COLUMNS = {
    "report_id": HOST,
    "page_ord": "page_id",
    "source_url": "CASE WHEN page_id % 23 = 0 THEN NULL ELSE url END",
    "status_code": "CASE page_id % 17 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 503 WHEN 3 THEN NULL ELSE 200 END",
    "title": "CASE page_id % 19 WHEN 0 THEN 'Page not found' WHEN 1 THEN ' Short ' WHEN 2 THEN NULL "
             "ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END",
    "description": "CASE page_id % 3 WHEN 0 THEN regexp_extract(html, '<p>([^<]*)', 1) "
                   "WHEN 1 THEN 'One description shared by many pages of the site, long enough to pass the rule.' END",
    "language": "regexp_extract(html, 'lang=\"([a-z]+)\"', 1)",
    "markdown": "CAST(NULL AS STRING)",
    "html": "CAST(NULL AS STRING)",
    "raw_html": f"replace(replace(html, '<head>', '<head>' || {_HEAD}), '</body>', {_BODY} || '</body>')",
}
DOCUMENT_COLUMNS = {
    "report_id": "source",
    "page_ord": "doc_id",
    "source_url": "'https://' || source || '.example.org/' || lang || '/' || CAST(doc_id AS STRING) || "
                  "(CASE doc_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '?q=1' ELSE '' END)",
    "status_code": "200",
    "title": "CASE doc_id % 9 WHEN 0 THEN 'The same title on many pages' ELSE 'Document ' || CAST(doc_id AS STRING) || "
             "' of ' || source END",
    "description": "CAST(NULL AS STRING)",
    "language": "lang",
    "markdown": _case("doc_id % 9", {
        0: f"'# Heading first' || {NL} || {NL} || text",
        1: f"'## TL;DR' || {NL} || {NL} || '- one' || {NL} || '- two' || {NL} || '1. three' || {NL} || text",
        2: f"'## One' || {NL} || text || {NL} || '## Two' || {NL} || 'It ' || text || {NL} || '## Three' || {NL} || "
           f"'- item' || {NL} || replace(text, {NL}, ' ') || {NL} || '## Four' || {NL} || {LONG} || {NL} || '## Five' || {NL} "
           f"|| '- skipped' || {NL} || 'This ' || {LONG}",
        3: f"text || {NL} || '| a | b |' || {NL} || '| 1 | 2 |' || {NL} || "
           "'See [one](https://en.wikipedia.org/wiki/A) and [two](https://example.com/x).'",
        4: f"'Growth of 40%, then 25 percent of $49 for 10k users; 3 in 10 stay, 1.5m left.' || {NL} || text",
        5: f"'### Is that so?' || {NL} || text || {NL} || '[home](https://' || source || '.example.org/a) "
           "[edu](https://www.mit.edu/x)'",
        6: f"'> quoted' || {NL} || '* star' || {NL} || text || {NL} || '### Summary' || {NL} || 'no list here'",
        7: "CAST(NULL AS STRING)"}, "text"),
    "html": "CASE doc_id % 9 WHEN 7 THEN '<h1>' || text || '</h1>' ELSE CAST(NULL AS STRING) END",
    "raw_html": "CAST(NULL AS STRING)",
}

_V = "(length(report_id) * 3 + ascii(right(report_id, 1)))"
SITE_COLUMNS = {
    "report_id": "report_id",
    "root_url": "CASE WHEN report_id LIKE 'src%' THEN 'https://' || report_id || '.example.org/' "
                "ELSE 'http://www.' || report_id || '/' END",
    "robots_status": f"CASE {_V} % 7 WHEN 0 THEN NULL WHEN 1 THEN 404 ELSE 200 END",
    "robots_body": _case(f"{_V} % 5", {
        0: f"'User-agent: *' || {NL} || 'Disallow: /'",
        1: f"'User-agent: GPTBot' || {NL} || 'Disallow: / # none' || {NL} || 'User-agent: *' || {NL} || 'Allow: /'",
        2: f"'User-agent: *' || {NL} || 'User-agent: other' || {NL} || 'Disallow: /'",
        3: f"'user-agent: *' || {NL} || 'Disallow: /admin' || {NL} || ' Sitemap: https://x.example/s.xml'"}),
    "sitemap_status": f"CASE {_V} % 4 WHEN 0 THEN 200 WHEN 1 THEN NULL ELSE 404 END",
    "llms_status": f"CASE {_V} % 3 WHEN 0 THEN 200 WHEN 1 THEN NULL ELSE 404 END",
    "h_fetched": f"{_V} % 9 <> 0",
    "h_hsts": _case(f"{_V} % 4", {0: "'max-age=31536000; includeSubDomains'", 1: "'max-age=300'", 2: "'max-age=0'"}),
    "h_csp": _case(f"{_V} % 5", {
        0: "'default-src https:; frame-ancestors none'", 1: "'script-src ''unsafe-inline'''".replace("''", "\""),
        2: "'default-src https:'"}),
    "h_nosniff": _case(f"{_V} % 2", {0: "'nosniff'"}),
    "h_xfo": _case(f"{_V} % 6", {0: "'DENY'", 1: "' '"}),
    "h_referrer": _case(f"{_V} % 3", {0: "'no-referrer'"}),
    "h_permissions": _case(f"{_V} % 4", {0: "'camera=()'"}),
    "h_robots": _case(f"{_V} % 10", {0: "'nosnippet'"}),
    "root_html": _case(f"{_V} % 5", {
        0: "'<html><script>gtag(\"consent\", \"default\", {})</script><script src=\"https://www.googletagmanager.com/"
           "gtm.js?id=GTM-ABC123\"></script><style>p{margin:0}</style><p>a b c d e f g h i j k l</p></html>'",
        1: "'<html><script src=\"https://www.googletagmanager.com/gtag/js?id=G-1\"></script>"
           "<script>gtag(\"consent\",\"default\",{})</script><p>one</p></html>'",
        2: "'<div id=\"app\"></div>'"}),
    "gtm_body": _case(f"{_V} % 3", {
        0: "'google_tag_manager G-ABCDEFGH1 AW-1234 analytics_storage ad_user_data ad_personalization fbevents'",
        1: "'gtm.start nothing else'"}),
}
HEADER_NAMES = {
    "h_hsts": "Strict-Transport-Security", "h_csp": "Content-Security-Policy", "h_nosniff": "X-Content-Type-Options",
    "h_xfo": "X-Frame-Options", "h_referrer": "Referrer-Policy", "h_permissions": "Permissions-Policy",
    "h_robots": "X-Robots-Tag",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _projection(columns: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns.items()]


def crawl(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The derived crawl: one row per page and one per document.

    ``dealt``: the rows as stored are dealt out to all tasks first, for passes over page bodies. A file may be one row group, which
    one task reads, however large it is.
    """
    pages, documents = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
    if dealt:  # by the bodies too, as keys may repeat or be null
        pages, documents = pages.repartition("page_id", "html"), documents.repartition("doc_id", "text")
    pages, documents = pages.selectExpr(*_projection(PAGE_COLUMNS)), documents.selectExpr(*_projection(DOCUMENT_COLUMNS))
    return pages.unionByName(documents).withColumn("status_code", F.col("status_code").cast("int"))


def raw_site_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-site fetch results as a crawler would record them; reads URLs and sources only, no page bodies."""
    reports = crawl(spark, sf_dir).select("report_id").distinct()
    return reports.selectExpr(*_projection(SITE_COLUMNS))


def site_aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_site_inputs(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(name).alias("key"), F.array(F.col(c)).alias("value"))
                      for c, name in HEADER_NAMES.items()])
    headers = F.when(F.col("h_fetched"), F.map_from_entries(F.filter(pairs, lambda p: p["value"][0] != "")))
    return site_inputs(raw.withColumn("headers", headers))


def crawl_sql() -> str:
    """The same crawl as a query for a second engine."""
    part = lambda cols, src: "SELECT " + ", ".join(_projection(cols)) + f" FROM {src}"
    return f"{part(PAGE_COLUMNS, 'pages')} UNION ALL {part(DOCUMENT_COLUMNS, 'documents')}"


def site_sql() -> str:
    return "SELECT " + ", ".join(_projection(SITE_COLUMNS)) + " FROM (SELECT DISTINCT report_id FROM crawl)"

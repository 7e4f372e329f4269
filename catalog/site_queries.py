"""URLs, domains, addresses, page picks and crawl bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.check_sql import PATH, comparable, host
from catalog.registry import register
from pageloom import workload
from pageloom.functions import network, urls
from pageloom.functions.text import plain_space, word_count
from pageloom.operators import sampling
from pageloom.sources.crawl import pages_from_html
from pageloom.workload import table

_PRIORITY = (
    "CASE WHEN regexp_matches(pth, 'pricing|/plans|/price') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(pth, "
    "'/(product|feature|solution|platform)') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(pth, '/(about|company|team)') THEN 6 ELSE 0 "
    "END + CASE WHEN regexp_matches(pth, '/(contact|services?)') THEN 4 ELSE 0 END - CASE WHEN regexp_matches(pth, "
    "'/(blog|news|article|post|tag|category)|/20\\d\\d/') THEN 6 ELSE 0 END - len(list_filter(string_split(pth, '/'), lambda s: s <> ''))")
_KIND = (
    "CASE WHEN pth IN ('', '/') THEN 'homepage' WHEN regexp_matches(pth, 'pricing|/plans|/price') THEN 'pricing' "
    "WHEN regexp_matches(pth, '/(about|company|team)') THEN 'about' WHEN regexp_matches(pth, '/(product|feature|solution|platform)') "
    "THEN 'product' WHEN regexp_matches(pth, '/(blog|news|article|post|guide)|/20\\d\\d/') THEN 'blog' WHEN regexp_matches(pth, "
    "'/(contact|support|help|docs?)') THEN 'contact' ELSE 'other' END")
_SENS = ("regexp_matches(regexp_replace(url, '(?i)^https?://[^/]+', ''), '(?i)/(wp-admin|wp-login|wp-json|administrator|admin|login|"
         "signin|sign-in|signup|sign-up|register|accounts?|dashboard|customers?|users?|profile|settings|preferences|checkout|cart|"
         "orders?|invoices?|preview|drafts?|staging|stage|dev|test|debug|server-status|phpmyadmin|\\.git|\\.env|\\.well-known|api|"
         "graphql|internal|private|backup|tmp|cache)(/|$|\\?|#)')")

# Links of the sites: every page's own URL and variants of it, with the section words the rules look for.
_SECTION = ("CASE page_id % 12 WHEN 0 THEN '/pricing/plan' WHEN 1 THEN '/product/x' WHEN 2 THEN '/about' WHEN 3 THEN '/blog/2024/p' "
            "WHEN 4 THEN '/contact' WHEN 5 THEN '/login?next=/a' WHEN 6 THEN '/api/v1/' WHEN 7 THEN '/docs/help#x' WHEN 8 THEN '' "
            "WHEN 9 THEN '/' WHEN 10 THEN '/users' ELSE '/en' END")
_LINK = f"regexp_extract(url, '^https?://[^/?#]+', 0) || ({_SECTION}) || (CASE page_id % 5 WHEN 0 THEN '/' || CAST(page_id AS STRING) WHEN 1 THEN '?p=' || CAST(page_id AS STRING) ELSE '' END)"
_LINKS_SQL = (f"links AS (SELECT {workload.HOST} AS report_id, page_id * 2 AS link_ord, url FROM pages UNION ALL SELECT {workload.HOST}, "
              f"page_id * 2 + 1, {_LINK} FROM pages)")
_ROOTS_SQL = f"roots AS (SELECT report_id, 'http://' || report_id || '/' AS root_url FROM (SELECT DISTINCT {workload.HOST} AS report_id FROM pages))"
_CANDS_SQL = (f"cands AS (SELECT report_id, root_url, k, arg_min(url, link_ord) AS url, min(link_ord) AS link_ord FROM (SELECT l.report_id, "
              f"root_url, url, link_ord, regexp_replace(regexp_replace(url, '[#?].*$', ''), '/$', '') AS k FROM links l JOIN roots r USING "
              f"(report_id) WHERE {host('url')} = {host('root_url')}) WHERE k <> '' AND k <> regexp_replace(regexp_replace(root_url, "
              "'[#?].*$', ''), '/$', '') GROUP BY ALL)")
_PICK_SQL = (f"picked AS (SELECT report_id, 0 AS pos, root_url AS url FROM roots UNION ALL SELECT report_id, pos, url FROM (SELECT report_id, "
             f"url, row_number() OVER (PARTITION BY report_id ORDER BY pr DESC, link_ord) AS pos FROM (SELECT *, {_PRIORITY} AS pr FROM "
             f"(SELECT *, lower(regexp_replace(url, '(?i)^https?://[^/]+', '')) AS pth FROM cands WHERE NOT {_SENS}))) WHERE pos <= 9)")


def _links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    own = pages.selectExpr(f"{workload.HOST} AS report_id", "page_id * 2 AS link_ord", "url")
    return own.unionByName(pages.selectExpr(f"{workload.HOST} AS report_id", "page_id * 2 + 1 AS link_ord", f"{_LINK} AS url"))


def _roots(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr(f"{workload.HOST} AS report_id").distinct().selectExpr(
        "report_id", "'http://' || report_id || '/' AS root_url")


def _with(select: str, *parts: str) -> str:
    return "WITH " + ", ".join(parts) + " " + select


@register("page_table_adapter", f"SELECT {workload.HOST} AS report_id, page_id AS page_ord, url AS source_url, regexp_extract(html, "
          "'(?is)<title[^>]*>(.*?)</title>', 1) AS title, length(html) AS chars, len(regexp_extract_all(html, "
          "'(?i)<a[^>]+href=[\"'']([^\"'']+)[\"'']', 1)) AS n_links FROM pages")
def page_table_adapter(spark, sf_dir):
    return pages_from_html(table(spark, sf_dir, "pages")).select(
        "report_id", "page_ord", "source_url", "title", F.length("raw_html").alias("chars"), F.size("links").alias("n_links"))


@register("url_parts", f"SELECT page_id, {host('url')} AS host, {PATH} AS path, regexp_replace(regexp_replace(url, '[#?].*$', ''), '/$', '') "
          f"AS dedupe_key, {comparable('url')} AS comparable FROM pages")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.host_of(u).alias("host"), urls.path_of(u).alias("path"), urls.dedupe_key(u).alias("dedupe_key"),
        urls.comparable(u).alias("comparable"))


@register("document_word_counts", "SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+')) AS words FROM documents")
def document_word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", word_count(plain_space(F.col("text"))).alias("words"))


@register("page_kinds", _with(f"SELECT report_id, link_ord, {_KIND} AS page_type, {_PRIORITY} AS priority, {_SENS} AS sensitive FROM "
          "(SELECT *, lower(regexp_replace(url, '(?i)^https?://[^/]+', '')) AS pth FROM links)", _LINKS_SQL))
def page_kinds(spark, sf_dir):
    u = F.col("url")
    return _links(spark, sf_dir).select(
        "report_id", "link_ord", urls.page_kind(u).alias("page_type"), urls.path_priority(u).alias("priority"),
        urls.is_sensitive(u).alias("sensitive"))


@register("link_candidates", _with("SELECT report_id, k AS key, url, link_ord FROM cands", _LINKS_SQL, _ROOTS_SQL, _CANDS_SQL))
def link_candidates(spark, sf_dir):
    return sampling.candidates(_links(spark, sf_dir), _roots(spark, sf_dir)).select("report_id", "key", "url", "link_ord")


@register("page_picks", _with("SELECT report_id, pos, url FROM picked", _LINKS_SQL, _ROOTS_SQL, _CANDS_SQL, _PICK_SQL))
def page_picks(spark, sf_dir):
    return sampling.pick_pages(_links(spark, sf_dir), _roots(spark, sf_dir), size=10)


@register("excluded_counts", _with(f"SELECT report_id, count(*) FILTER ({_SENS}) AS pages_excluded FROM cands GROUP BY report_id",
                                   _LINKS_SQL, _ROOTS_SQL, _CANDS_SQL))
def excluded_counts(spark, sf_dir):
    return sampling.excluded_counts(_links(spark, sf_dir), _roots(spark, sf_dir))


@register("exploded_links", f"SELECT {workload.HOST} AS report_id, CAST(i AS INT) AS link_ord, count(*) AS n FROM (SELECT url, "
          "unnest(range(len(l))) AS i, unnest(l) AS u FROM (SELECT url, regexp_extract_all(html, '(?i)<a[^>]+href=[\"'']([^\"'']+)[\"'']', "
          "1) AS l FROM pages)) WHERE u <> '' GROUP BY ALL")
def exploded_links(spark, sf_dir):
    """Links of every page; every other entry arrives as a record instead of a bare URL."""
    pages = pages_from_html(table(spark, sf_dir, "pages")).select("report_id", F.transform(
        "links", lambda l, i: F.when(i % 3 == 0, F.to_json(F.struct(l.alias("url")))).when(
            i % 3 == 1, F.to_json(F.struct(l.alias("href")))).otherwise(l)).alias("links"))
    return sampling.exploded_links(pages).groupBy("report_id", "link_ord").agg(F.count("*").alias("n"))


# Crawl bookkeeping: what was submitted is every page and document URL plus picks that never came back.
_SUBMITTED = ("submitted AS (SELECT report_id, page_ord * 2 AS url_ord, source_url AS url FROM crawl WHERE source_url IS NOT NULL UNION ALL "
              "SELECT report_id, page_ord * 2 + 1, source_url || '/gone' FROM crawl WHERE source_url IS NOT NULL AND status_code = 404)")
_RETURNED_PATH = PATH.replace("url", "source_url")


def _submitted(spark, sf_dir):
    known = workload.crawl(spark, sf_dir).filter("source_url IS NOT NULL").select(
        "report_id", "page_ord", "source_url", "status_code")
    gone = known.filter("status_code = 404").select(
        "report_id", (F.col("page_ord") * 2 + 1).alias("url_ord"), F.concat("source_url", F.lit("/gone")).alias("url"))
    return known.select("report_id", (F.col("page_ord") * 2).alias("url_ord"), F.col("source_url").alias("url")).unionByName(gone)


def _returned(spark, sf_dir):
    """Rows of pages answered with an error come back without content."""
    empty = F.col("status_code").isin(404, 503)
    blank = {c: F.when(~F.coalesce(empty, F.lit(False)), F.col(c)) for c in ("html", "raw_html", "markdown")}
    return workload.crawl(spark, sf_dir).withColumns(blank)


@register("failed_pages", _with(
    "SELECT report_id, pass_no, ord, path, reason, CASE reason WHEN '4xx' THEN 'returned a 4xx error' WHEN '5xx' THEN 'returned a 5xx server error' "
    "WHEN 'no-content' THEN 'returned no usable content' ELSE 'timed out / never returned' END AS text FROM (SELECT report_id, path, 0 AS pass_no, min(page_ord) AS ord, CASE WHEN "
    "arg_min(coalesce(status_code, 0), page_ord) >= 500 THEN '5xx' WHEN arg_min(coalesce(status_code, 0), page_ord) >= 400 THEN '4xx' ELSE "
    f"'no-content' END AS reason FROM ret GROUP BY report_id, path HAVING NOT bool_or(good) UNION ALL SELECT report_id, {PATH} AS path, 1, "
    "min(url_ord), 'timeout' FROM submitted WHERE report_id IN (SELECT report_id FROM (SELECT report_id, count(*) AS asked FROM submitted GROUP "
    "BY 1) LEFT JOIN (SELECT report_id, count(*) AS got FROM crawl GROUP BY 1) USING (report_id) WHERE coalesce(got, 0) < asked) GROUP BY "
    "report_id, path HAVING (report_id, path) NOT IN (SELECT (report_id, path) FROM ret))",
    f"crawl AS ({workload.crawl_sql()})", _SUBMITTED,
    f"ret AS (SELECT report_id, page_ord, status_code, {_RETURNED_PATH} AS path, coalesce(status_code NOT IN (404, 503), true) AND "
    "(coalesce(html, '') <> '' OR coalesce(raw_html, '') <> '' OR coalesce(markdown, '') <> '') AS good FROM crawl WHERE source_url IS NOT "
    "NULL)"))
def failed_pages(spark, sf_dir):
    out = sampling.failed_pages(_submitted(spark, sf_dir), _returned(spark, sf_dir), content_only=True)
    return out.withColumn("text", sampling.failed_text(F.col("reason")))


@register("crawl_counts", _with(
    "SELECT s.report_id, asked AS pages_attempted, coalesce(n, 0) AS pages_sampled FROM (SELECT report_id, count(*) AS asked FROM submitted "
    "GROUP BY 1) s LEFT JOIN (SELECT report_id, count(*) AS n FROM crawl GROUP BY 1) c USING (report_id)",
    f"crawl AS ({workload.crawl_sql()})", _SUBMITTED))
def crawl_counts(spark, sf_dir):
    from pageloom.operators.facts import usable

    return sampling.crawl_counts(_submitted(spark, sf_dir), usable(workload.crawl(spark, sf_dir)))


# Submissions: what users type, made of customer names and keys.
_TYPED = ("CASE c_custkey % 16 WHEN 0 THEN ' www.' || stem || '.com ' WHEN 1 THEN 'HTTPS://WWW.' || stem || '.CO.UK/path?x=1' WHEN 2 THEN stem "
          "WHEN 3 THEN 'ftp://' || stem || '.com' WHEN 4 THEN '10.' || CAST(c_custkey % 256 AS STRING) || '.0.1' WHEN 5 THEN stem || '.local' "
          "WHEN 6 THEN stem || '.c0m' WHEN 7 THEN '-' || stem || '.com' WHEN 8 THEN 'http://user:pw@' || stem || '.io:8080/a' WHEN 9 THEN "
          "stem || ' x.com' WHEN 10 THEN '' WHEN 11 THEN 'localhost' WHEN 12 THEN 'https://[::1]/' WHEN 13 THEN repeat(stem, 20) || '.org' "
          "WHEN 14 THEN 'xn--' || stem || '.xn--p1ai' ELSE stem || '..com' END")
_STEM = "replace(lower(c_name), '#', '-')"


@register("normalized_domains", f"""WITH s AS (SELECT c_custkey, {_TYPED} AS typed FROM (SELECT *, {_STEM} AS stem FROM customer)),
h AS (SELECT *, trim(typed) AS raw, regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(CASE WHEN regexp_matches(trim(typed),
  '(?i)^https?://') THEN trim(typed) ELSE 'https://' || trim(typed) END, '(?i)^https?://([^/?#]*)', 1), '^.*@', ''), '([a-z0-9]):[0-9]+$', '\\1')),
  '^www[.]', '') AS host FROM s),
e AS (SELECT c_custkey, host, CASE WHEN raw = '' THEN 'Enter a website domain to audit.' WHEN length(raw) > 253 THEN 'That domain is too long.'
  WHEN regexp_matches(raw, '^[a-z]+://') AND NOT regexp_matches(raw, '(?i)^https?://') THEN 'Only http(s) websites are supported - try a domain like example.com.'
  WHEN contains(host, ' ') THEN 'That does not look like a valid domain. Try example.com.'
  WHEN regexp_matches(host, '^[0-9.]+$') OR contains(host, ':') THEN 'Enter a domain name (e.g. example.com), not an IP address.'
  WHEN host = 'localhost' OR ends_with(host, '.local') THEN 'Enter a public website domain (e.g. example.com).'
  WHEN NOT contains(host, '.') THEN 'Enter a full domain with an ending, like example.com.'
  WHEN NOT regexp_matches(split_part(host, '.', -1), '^([a-z]{{2,}}|xn--[a-z0-9]+)$') THEN 'That domain ending doesn''t look valid (try .com, .io, .org, …).'
  WHEN len(list_filter(string_split(host, '.'), lambda l: NOT regexp_matches(l, '^[a-z0-9-]{{1,63}}$') OR starts_with(l, '-') OR ends_with(l, '-'))) > 0
  THEN 'That does not look like a valid domain. Try example.com.' END AS error FROM h)
SELECT c_custkey, error IS NULL AS ok, CASE WHEN error IS NULL THEN host END AS domain, CASE WHEN error IS NULL THEN 'https://' || host END AS root_url,
  error FROM e""")
def normalized_domains(spark, sf_dir):
    typed = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_STEM} AS stem").selectExpr("c_custkey", f"{_TYPED} AS typed")
    return network.normalize_domains(typed, "typed").select("c_custkey", "ok", "domain", "root_url", "error")


_IP = ("CASE o_orderkey % 9 WHEN 8 THEN (CASE o_custkey % 8 WHEN 0 THEN '::1' WHEN 1 THEN 'fe80::' || CAST(o_orderkey % 97 AS STRING) WHEN 2 THEN "
       "'fd00:1::2' WHEN 3 THEN '2001:db8::' || CAST(o_orderkey % 97 AS STRING) WHEN 4 THEN '::ffff:127.0.0.1' WHEN 5 THEN '::ffff:8.8.8.8' WHEN 6 "
       "THEN 'not-an-ip' ELSE '300.1.1.1' END) ELSE CAST((CASE o_orderkey % 7 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 WHEN 3 THEN 169 WHEN 4 "
       "THEN 100 ELSE o_custkey % 256 END) AS STRING) || '.' || CAST((CASE o_orderkey % 5 WHEN 0 THEN 168 WHEN 1 THEN 254 WHEN 2 THEN 0 ELSE "
       "o_orderkey % 256 END) AS STRING) || '.' || CAST(o_custkey % 4 AS STRING) || '.7' END")
_PRIV = ("CASE WHEN ip IN ('::1', 'fd00:1::2', '::ffff:127.0.0.1', 'not-an-ip', '300.1.1.1') OR starts_with(ip, 'fe80:') THEN true WHEN "
         "contains(ip, ':') THEN false ELSE a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR "
         "(a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 192 AND b = 0 AND c = 0) END")
_IPS = (f"ips AS (SELECT *, TRY_CAST(split_part(ip, '.', 1) AS INT) AS a, TRY_CAST(split_part(ip, '.', 2) AS INT) AS b, TRY_CAST(split_part(ip, "
        f"'.', 3) AS INT) AS c FROM (SELECT o_orderkey, 'd' || CAST(o_custkey AS STRING) || '.example.com' AS domain, {_IP} AS ip FROM orders))")


def _addresses(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "'d' || CAST(o_custkey AS STRING) || '.example.com' AS domain", f"{_IP} AS ip")


@register("private_addresses", _with(f"SELECT o_orderkey, ip, {_PRIV} AS is_private FROM ips", _IPS))
def private_addresses(spark, sf_dir):
    return _addresses(spark, sf_dir).select("o_orderkey", "ip", network.is_private_ip(F.col("ip")).alias("is_private"))


@register("refused_domains", _with(f"SELECT domain, bool_or({_PRIV}) AS refused FROM ips GROUP BY domain", _IPS))
def refused_domains(spark, sf_dir):
    return network.refused_domains(_addresses(spark, sf_dir))


_HOSTNAME = ("CASE c_custkey % 9 WHEN 0 THEN stem || '.lan' WHEN 1 THEN stem || '.home.arpa:80' WHEN 2 THEN stem WHEN 3 THEN '192.0.2.' || "
             "CAST(c_custkey % 256 AS STRING) WHEN 4 THEN '8.8.4.' || CAST(c_custkey % 300 AS STRING) WHEN 5 THEN stem || '.internal.' WHEN 6 THEN "
             "'[::1]' WHEN 7 THEN '[2001:db8::1]' ELSE stem || '.com:443' END")


@register("private_hosts", f"SELECT c_custkey, host, c_custkey % 9 IN (0, 1, 2, 3, 5, 6) OR (c_custkey % 9 = 4 AND c_custkey % 300 > 255) "
          f"AS is_private FROM (SELECT c_custkey, {_HOSTNAME} AS host FROM (SELECT *, {_STEM} AS stem FROM customer))")
def private_hosts(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_STEM} AS stem").selectExpr("c_custkey", f"{_HOSTNAME} AS host")
    return df.select("c_custkey", "host", network.is_private_host(F.col("host")).alias("is_private"))


@register("client_addresses", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '1.1.1.' || user_id WHEN 1 THEN '2.2.2.' || user_id WHEN 2 THEN "
          "'3.3.3.' || user_id ELSE 'unknown' END AS client FROM events")
def client_addresses(spark, sf_dir):
    user = F.col("user_id").cast("string")
    entry = lambda name, value, when: F.when(when, F.create_map(F.lit(name), value)).otherwise(
        F.create_map().cast("map<string,string>"))
    k = F.col("event_id") % 4
    headers = F.map_concat(
        entry("x-vercel-forwarded-for", F.concat(F.lit(" 1.1.1."), user, F.lit(", 9.9.9.9")), k == 0),
        entry("x-forwarded-for", F.concat(F.lit("2.2.2."), user, F.lit(" ,8.8.8.8")), k <= 1),
        entry("x-real-ip", F.concat(F.lit("3.3.3."), user), k <= 2))
    return table(spark, sf_dir, "events").select("event_id", network.client_address(headers).alias("client"))


"""Validation of documents, triggers, leads and events; redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import register
from pageloom.functions.urls import redacted
from pageloom.operators import contract
from pageloom.sources.crawl import read_results
from pageloom.workload import table

# Result documents, one per customer: the key decides which defect (if any) the document has.
_K = "c_custkey % 22"


def _piece(branches: dict[int, str], default: str) -> str:
    return f"(CASE {_K} " + " ".join(f"WHEN {k} THEN {v}" for k, v in branches.items()) + f" ELSE {default} END)"


def _dim(name: str, checks: str = "'[]'") -> str:
    score = _piece({7: "''"}, "'\"score\":50.5,'") if name == "geo" else "'\"score\":50.5,'"
    ident = _piece({6: "'foo'"}, f"'{name}'") if name == "geo" else f"'{name}'"
    return f"'{{\"id\":\"' || {ident} || '\",\"label\":\"L\",' || {score} || '\"rawScore\":60,\"capped\":false,\"checks\":' || {checks} || '}}'"


_CHECKS = ("'[{\"id\":\"S1\",\"ratio\":0.5,\"evidence\":{\"where\":\"w\",\"checked\":2,\"failing\":[{\"path\":\"' || "
           + _piece({11: "'/gone'"}, "'/a'") + " || '\"}]}},{\"id\":\"S2\",\"ratio\":null}]'")
_PAYLOAD = " || ".join([
    "'{\"overall\":'", _piece({1: "'101'", 2: "'\"50\"'"}, "CAST(c_custkey % 101 AS STRING)"),
    "',\"grade\":\"'", _piece({3: "'G'"}, "'B'"), "'\",\"capped\":'", _piece({4: "'1'"}, "'true'"),
    "',\"dimensions\":['", _dim("seo", _CHECKS), "','", _dim("tracking"), "','", _dim("geo"),
    _piece({5: "''"}, f"',' || {_dim('tech')}"), "']'",
    _piece({17: "''", 8: "',\"actionPlan\":[{\"checkId\":\"S1\",\"severity\":\"high\"}]'"},
           "',\"actionPlan\":[{\"checkId\":\"S1\",\"finding\":\"f\",\"severity\":\"high\",\"extra\":1}]'"),
    _piece({10: "''", 18: "',\"pages\":[{\"path\":\"\"}]'", 9: "',\"pages\":[{\"path\":\"/a\"},{\"path\":\"/b\u202ec\"}]'",
            20: "',\"pages\":{}'"}, "',\"pages\":[{\"path\":\"/a\"},{\"path\":\"/\"}]'"),
    _piece({12: "',\"pagesWithIssues\":1.5'", 21: "',\"pagesWithIssues\":2'"}, "''"),
    _piece({13: "',\"pagesExcluded\":-1'"}, "',\"pagesExcluded\":0'"),
    _piece({14: "',\"pagesFailed\":[{\"path\":\"/x\",\"reason\":\"weird\"}]'"}, "',\"pagesFailed\":[{\"path\":\"/x\",\"reason\":\"4xx\"}]'"),
    "',\"summary\":null}'",
])
_STORED = (f"CASE {_K} WHEN 15 THEN 'not json' WHEN 19 THEN NULL WHEN 16 THEN '\"' || replace({_PAYLOAD}, '\"', chr(92) || '\"') || '\"' ELSE {_PAYLOAD} END")
_PAYLOADS = (f"pl AS (SELECT c_custkey, raw, CASE WHEN starts_with(raw, '\"') THEN json_extract_string(raw, '$') WHEN starts_with(raw, '{{') THEN raw END AS j FROM (SELECT "
             f"c_custkey, {_STORED} AS raw FROM customer))")
_NUM = "json_type(j, '$.{f}') IN ('BIGINT', 'UBIGINT', 'DOUBLE')"
_SAFE = "length({p}) BETWEEN 1 AND 250 AND NOT regexp_matches({p}, '[\\x00-\\x1f\\x7f\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{2069}}\\x{{feff}}]')"
_COUNT = ("json_type(j, '$.{f}') IS NULL OR (json_type(j, '$.{f}') IN ('BIGINT', 'UBIGINT') AND CAST(json_extract(j, '$.{f}') AS BIGINT) >= 0)")
_LIST = "TRY_CAST(json_extract(j, '$.{f}') AS JSON[])"
_RULES = {
    "overall": _NUM.format(f="overall") + " AND CAST(json_extract(j, '$.overall') AS DOUBLE) BETWEEN 0 AND 100",
    "grade": "json_extract_string(j, '$.grade') IN ('A', 'B', 'C', 'D', 'F')",
    "capped": "json_type(j, '$.capped') = 'BOOLEAN'",
    "dimensions": "json_array_length(j, '$.dimensions') = 4 AND len(list_filter(" + _LIST.format(f="dimensions") + ", lambda d: json_extract_string(d, '$.id') IN ('seo', 'tracking', "
                  "'geo', 'tech') AND json_type(d, '$.score') IS NOT NULL AND json_type(d, '$.rawScore') IS NOT NULL)) = 4",
    "actionPlan": "json_type(j, '$.actionPlan') = 'ARRAY' AND len(list_filter(" + _LIST.format(f="actionPlan") + ", lambda a: json_type(a, '$.finding') IS NULL)) = 0",
    "pages": "json_type(j, '$.pages') IS NULL OR (json_type(j, '$.pages') = 'ARRAY' AND len(list_filter(" + _LIST.format(f="pages") + ", lambda p: NOT ("
             + _SAFE.format(p="json_extract_string(p, '$.path')") + "))) = 0)",
    "pagesWithIssues": _COUNT.format(f="pagesWithIssues"),
    "pagesExcluded": _COUNT.format(f="pagesExcluded"),
    "pagesFailed": "json_type(j, '$.pagesFailed') IS NULL OR len(list_filter(" + _LIST.format(f="pagesFailed") + ", lambda p: json_extract_string(p, '$.reason') NOT IN ('4xx', "
                   "'5xx', 'no-content', 'timeout'))) = 0",
}
_BROKEN = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce(({r}), false) THEN '{n}' END" for n, r in _RULES.items()) + ")"
_MIRROR = ("json_type(j, '$.pages') IS NULL OR len(list_filter(json_extract_string(j, '$.dimensions[*].checks[*].evidence.failing[*].path'), lambda p: NOT list_contains("
           "json_extract_string(j, '$.pages[*].path'), p))) = 0")


@register("validated_results", f"WITH {_PAYLOADS}, b AS (SELECT c_custkey, j, CASE WHEN j IS NULL THEN 'json' ELSE {_BROKEN} END AS br FROM pl), v AS (SELECT c_custkey, j, CASE WHEN "
          f"br = '' AND NOT ({_MIRROR}) THEN 'mirror' ELSE br END AS violations FROM b) SELECT c_custkey, violations, CASE WHEN violations = '' THEN 'strict' WHEN j IS NOT NULL AND "
          f"{_NUM.format(f='overall')} AND json_type(j, '$.dimensions') = 'ARRAY' AND coalesce(json_type(j, '$.actionPlan') = 'ARRAY', false) THEN 'minimal' ELSE 'rejected' END AS "
          "tier FROM v")
def validated_results(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_STORED} AS raw")
    return contract.validate_results(df, "raw").select("c_custkey", F.array_join("violations", ",").alias("violations"), "tier")


@register("tolerant_json", f"WITH {_PAYLOADS} SELECT c_custkey, CASE WHEN {_NUM.format(f='overall')} THEN CAST(json_extract(j, '$.overall') AS DOUBLE) END AS overall, "
          "json_extract_string(j, '$.grade') AS grade, json_array_length(j, '$.dimensions') AS n_dimensions FROM pl")
def tolerant_json(spark, sf_dir):
    df = read_results(table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_STORED} AS raw"), "raw")
    return df.select("c_custkey", "doc.overall", "doc.grade", F.when(F.col("doc.dimensions").isNotNull(), F.size("doc.dimensions")).alias("n_dimensions"))


_PATHS = ("CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '/a\u200e' WHEN 2 THEN '/' || replace(text, chr(10), ' ') WHEN 3 THEN '/x' || chr(127) WHEN 4 THEN '/' || lang ELSE "
          "text END")


@register("safe_paths", f"SELECT doc_id, {_SAFE.format(p='p')} AS safe FROM (SELECT doc_id, {_PATHS} AS p FROM documents)")
def safe_paths(spark, sf_dir):
    df = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PATHS} AS p")
    return df.select("doc_id", contract.safe_path(F.col("p")).alias("safe"))


_HEX = "lpad(CAST(o_orderkey AS STRING), 12, '0')"
_TRIGGER = {
    "rid": f"CASE o_orderkey % 4 WHEN 0 THEN 'not-a-uuid' ELSE '0a1b2c3d-0000-4000-8000-' || {_HEX} END",
    "root": "CASE o_orderkey % 5 WHEN 0 THEN 'example.com' WHEN 1 THEN 'https://' ELSE 'https://d' || CAST(o_custkey AS STRING) || '.example.com' END",
    "dom": "CASE o_orderkey % 3 WHEN 0 THEN '' ELSE 'd' || CAST(o_custkey AS STRING) || '.example.com' END",
}


@register("trigger_rules", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'reportId' END, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'rootUrl' END, CASE WHEN "
          "o_orderkey % 3 = 0 THEN 'domain' END) AS violations FROM orders")
def trigger_rules(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *[f"{e} AS {n}" for n, e in _TRIGGER.items()])
    v = contract.trigger_violations(F.col("rid"), F.col("root"), F.col("dom"))
    return df.select("o_orderkey", F.array_join(v, ",").alias("violations"))


# Leads: conversation turns with contact data derived from their keys.
_LEAD = {
    "id": "conv_id * 1000 + turn",
    "name": "CASE turn % 4 WHEN 0 THEN ' A ' WHEN 1 THEN 'Name ' || CAST(conv_id AS STRING) WHEN 2 THEN repeat('n', 150) ELSE repeat('n', 300) END",
    "email": "CASE (conv_id + turn) % 6 WHEN 0 THEN 'user' || CAST(conv_id AS STRING) || '@example.com' WHEN 1 THEN 'bad@@example' WHEN 2 THEN 'x@Mailinator.com ' WHEN 3 THEN "
             "'a..b@example.com' WHEN 4 THEN 'u@sub.yopmail.com' ELSE repeat('e', 250) || '@example.com' END",
    "message": "text",
    "plan": "CASE conv_id % 4 WHEN 0 THEN 'pro' WHEN 1 THEN 'agency' WHEN 2 THEN 'gold' END",
    "company": "CASE conv_id % 3 WHEN 0 THEN repeat('c', 130) WHEN 1 THEN repeat('c', 220) END",
    "topic": "CASE conv_id % 5 WHEN 0 THEN repeat('t', 70) WHEN 1 THEN repeat('t', 120) END",
    "handled": "turn % 7 = 0",
}
_LEADS = "leads AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _LEAD.items()) + " FROM conversations)"
_TRIM = lambda c: f"length(trim({c}, ' ' || chr(10) || chr(9) || chr(13)))"
_when = lambda pairs: "concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in pairs) + ")"


def _leads(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr(*[f"{e} AS {n}" for n, e in _LEAD.items()])


@register("lead_rules", f"WITH {_LEADS} SELECT id, " + _when([
    ("name", f"{_TRIM('name')} BETWEEN 2 AND 100"),
    ("email", f"regexp_matches(trim(email), '^[A-Za-z0-9_+-]+@([A-Za-z0-9-]+\\.)+[A-Za-z]{{2,}}$') AND {_TRIM('email')} <= 200"),
    ("message", f"{_TRIM('message')} BETWEEN 10 AND 2000"), ("plan", "coalesce(plan IN ('pro', 'agency'), true)"),
    ("company", "coalesce(length(company) <= 120, true)"), ("topic", "coalesce(length(topic) <= 60, true)")]) + " AS violations FROM leads")
def lead_rules(spark, sf_dir):
    df = _leads(spark, sf_dir)
    v = contract.lead_violations({c: F.col(c) for c in df.columns})
    return df.select("id", F.array_join(v, ",").alias("violations"))


@register("lead_backstop_rules", f"WITH {_LEADS} SELECT id, " + _when([
    ("handled", "NOT handled"), ("name", "length(name) BETWEEN 1 AND 200"), ("email", "length(email) BETWEEN 3 AND 320"),
    ("message", "length(message) BETWEEN 1 AND 5000"), ("company", "coalesce(length(company) <= 200, true)"),
    ("topic", "coalesce(length(topic) <= 100, true)"), ("plan", "coalesce(length(plan) <= 50, true)")]) + " AS violations FROM leads")
def lead_backstop_rules(spark, sf_dir):
    df = _leads(spark, sf_dir)
    v = contract.lead_backstop_violations({c: F.col(c) for c in df.columns})
    return df.select("id", F.array_join(v, ",").alias("violations"))


@register("disposable_emails", f"WITH {_LEADS} SELECT id, lower(trim(email)) LIKE '%@mailinator.com' AS disposable FROM leads")
def disposable_emails(spark, sf_dir):
    return _leads(spark, sf_dir).select("id", contract.is_disposable(F.col("email")).alias("disposable"))


_EVENT = ("CASE event_type WHEN 'signup' THEN 'sign_up' WHEN 'view' THEN 'report_viewed' WHEN 'purchase' THEN 'audit_completed' WHEN 'click' THEN 'contact_cta_click' ELSE 'unknown' "
          "END")
_PARAMS = ("CASE event_id % 4 WHEN 0 THEN '{\"method\":\"password\"}' WHEN 1 THEN '{\"report_id\":\"r\",\"email\":\"x\"}' WHEN 2 THEN '{\"audit_domain\":\"d\",\"report_id\":\"r\","
           "\"audit_status\":\"done\"}' ELSE props END")


@register("event_contract", f"SELECT event_id, array_to_string(list_sort(list_filter(json_keys(p), lambda k: NOT list_contains(CASE e WHEN 'sign_up' THEN ['method'] WHEN "
          "'report_viewed' THEN ['report_id'] WHEN 'audit_completed' THEN ['audit_domain', 'report_id', 'audit_status'] WHEN 'contact_cta_click' THEN ['audit_domain'] ELSE [] END, "
          f"k))), ',') AS extra FROM (SELECT event_id, {_EVENT} AS e, {_PARAMS} AS p FROM events)")
def event_contract(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr("event_id", f"{_EVENT} AS e", f"{_PARAMS} AS p")
    extra = contract.event_violations(F.col("e"), F.json_object_keys("p"))
    return df.select("event_id", F.array_join(F.array_sort(extra), ",").alias("extra"))


_LOG_LINE = ("'fetch of ' || url || ' failed (see \"https://user:pw@host.example/p?q=1\" and https://plain.example) ' || CASE page_id % 3 WHEN 0 THEN 'HTTP://X.EXAMPLE?token=1' "
             "WHEN 1 THEN 'https://a:b@c.example' ELSE '' END")


@register("redacted_urls", "SELECT page_id, 'fetch of ' || regexp_replace(url, '^(https?://[^/?#]+)[/?#].*$', '\\1/[redacted]') || ' failed (see \"https://host.example/[redacted]\" "
          "and https://plain.example) ' || CASE page_id % 3 WHEN 0 THEN 'HTTP://X.EXAMPLE/[redacted]' WHEN 1 THEN 'https://c.example' ELSE '' END AS line FROM pages")
def redacted_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{_LOG_LINE} AS line").select("page_id", redacted(F.col("line")).alias("line"))


@register("redacted_fields", f"WITH {_PAYLOADS} SELECT c_custkey, CASE WHEN j IS NOT NULL THEN CASE WHEN json_type(j, '$.pages') = 'ARRAY' THEN '[scrubbed] (' || "
          "json_array_length(j, '$.pages') || ' entries)' ELSE '[scrubbed]' END END AS pages, '[scrubbed] (' || length(c_name) || ' chars)' AS root FROM pl JOIN customer USING "
          "(c_custkey)")
def redacted_fields(spark, sf_dir):
    df = read_results(table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_STORED} AS raw", "c_name AS rootUrl"), "raw").drop("raw")
    out = contract.redact_fields(df)
    return out.select("c_custkey", F.col("doc.pages").alias("pages"), F.col("rootUrl").alias("root"))

"""Credits, limits, retention, ownership, conversations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.registry import facts, register, results
from pageloom.operators import access, corpus, limits, scoring
from pageloom.session import shared_folder
from pageloom.sources import sinks
from pageloom.workload import table

LATE = datetime(2024, 2, 1)

# Ledger events: purchases and sign-ups consume a credit, errors give one back, the rest is no ledger event.
_KIND = "CASE event_type WHEN 'error' THEN 'refund' WHEN 'purchase' THEN 'consume' WHEN 'signup' THEN 'consume' END"
# Reports: one per event; its life is a status log that the event type decides.
_REPORT_SQL = ("reports AS (SELECT 'r' || CAST(event_id AS STRING) AS report_id, user_id, ts AS created_at, CASE event_type WHEN 'error' THEN 'error' "
               "WHEN 'view' THEN 'done' WHEN 'click' THEN 'queued' WHEN 'signup' THEN 'crawling' ELSE 'embedding' END AS status, CASE WHEN "
               "event_type = 'view' THEN CAST(floor(value) AS INT) % 101 END AS score_overall, CASE WHEN event_type = 'signup' THEN '' WHEN event_type = "
               "'purchase' THEN 'slow' END AS error, 'd' || CAST(user_id AS STRING) || '.example.com' AS domain FROM events)")
_RETURNED = ("CASE WHEN kind = 'consume' THEN CASE WHEN nxt = prev THEN -1 ELSE nxt END ELSE nxt END")


def _reports(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "'r' || CAST(event_id AS STRING) AS report_id", "user_id", "ts AS created_at",
        "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'done' WHEN 'click' THEN 'queued' WHEN 'signup' THEN 'crawling' "
        "ELSE 'embedding' END AS status",
        "CASE WHEN event_type = 'view' THEN CAST(floor(value) AS INT) % 101 END AS score_overall",
        "CASE WHEN event_type = 'signup' THEN '' WHEN event_type = 'purchase' THEN 'slow' END AS error",
        "'d' || CAST(user_id AS STRING) || '.example.com' AS domain")


@register("monthly_usage", "SELECT user_id, strftime(ts, '%Y-%m') AS period, count(*) AS count FROM events GROUP BY ALL")
def monthly_usage(spark, sf_dir):
    return limits.monthly_usage(table(spark, sf_dir, "events"))


@register("usage_view", "SELECT user_id, strftime(ts, '%Y-%m') AS period, count(*) AS count, CAST(greatest(0, 3 - count(*)) AS INT) AS remaining, "
          "CAST(least(100, floor(count(*) / 3 * 100 + 0.5)) AS INT) AS percent FROM events GROUP BY ALL")
def usage_view(spark, sf_dir):
    return limits.usage_view(limits.monthly_usage(table(spark, sf_dir, "events")))


def _ledger_events(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts", f"{_KIND} AS kind").filter(
        "kind IS NOT NULL").withColumn("period", limits.period(F.col("ts")))


_LEDGER_SQL = """WITH RECURSIVE ev AS (SELECT event_id, user_id, strftime(ts, '%Y-%m') AS period, {kind} AS kind,
  row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS i FROM events WHERE {kind} IS NOT NULL),
walk AS (SELECT event_id, user_id, period, kind, i, 0 AS prev, CASE WHEN kind = 'consume' THEN 1 ELSE 0 END AS nxt FROM ev WHERE i = 1
  UNION ALL SELECT e.event_id, e.user_id, e.period, e.kind, e.i, w.nxt, CASE WHEN e.kind = 'consume' THEN least(w.nxt + 1, 3)
  ELSE greatest(w.nxt - 1, 0) END FROM walk w JOIN ev e ON e.user_id = w.user_id AND e.period = w.period AND e.i = w.i + 1)"""


@register("credit_ledger", _LEDGER_SQL.format(kind=_KIND) + f" SELECT event_id, user_id, period, kind, {_RETURNED} AS returned FROM walk")
def credit_ledger(spark, sf_dir):
    return limits.credit_ledger(_ledger_events(spark, sf_dir), cap=999_999)


# Status log: several events share a report (three of a user's events), so a report can fail more than once.
_LOG_SQL = ("log AS (SELECT event_id, 'u' || CAST(user_id AS STRING) || '-' || CAST(event_id % 40 AS STRING) AS report_id, user_id, ts, CASE "
            "event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'done' WHEN 'click' THEN 'queued' WHEN 'signup' THEN 'crawling' ELSE "
            "'embedding' END AS status, value FROM events)")


def _status_log(spark, sf_dir):
    log = table(spark, sf_dir, "events").selectExpr(
        "event_id", "'u' || CAST(user_id AS STRING) || '-' || CAST(event_id % 40 AS STRING) AS report_id", "user_id", "ts",
        "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'done' WHEN 'click' THEN 'queued' WHEN 'signup' THEN 'crawling' "
        "ELSE 'embedding' END AS status", "value")
    return log


@register("refunds_on_error", f"WITH {_LOG_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY report_id, status ORDER BY ts, event_id) AS i FROM log) "
          "SELECT report_id, event_id, user_id, strftime(ts, '%Y-%m') AS period, ts, 'refund' AS kind FROM c WHERE status = 'error' AND i = 1")
def refunds_on_error(spark, sf_dir):
    log = _status_log(spark, sf_dir)
    return limits.refunds_on_error(log.withColumn("created_at", F.col("ts")))


_CHAT_SQL = ("msgs AS (SELECT conv_id AS report_id, conv_id * 1000 + turn AS message_id, CASE WHEN turn % 6 = 4 THEN conv_id + 1 ELSE conv_id END "
             "AS user_id, role, text AS content FROM conversations)")


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS report_id", "conv_id * 1000 + turn AS message_id",
        "CASE WHEN turn % 6 = 4 THEN conv_id + 1 ELSE conv_id END AS user_id", "role", "text AS content")


@register("chat_cap", f"WITH {_CHAT_SQL}, m AS (SELECT *, report_id = user_id AS mine, count(*) FILTER (report_id = user_id) OVER (PARTITION BY "
          "report_id ORDER BY message_id) AS pos FROM msgs WHERE role = 'user') SELECT report_id, message_id, CASE WHEN NOT mine THEN 0 WHEN pos <= 2 "
          "THEN message_id ELSE -1 END AS returned, CASE WHEN mine AND pos <= 2 THEN content END AS stored FROM m")
def chat_cap(spark, sf_dir):
    owners = _messages(spark, sf_dir).select("report_id").distinct().withColumn("user_id", F.col("report_id"))
    return limits.chat_cap(_messages(spark, sf_dir), owners, cap=2)


@register("conversation_history", f"WITH {_CHAT_SQL} SELECT report_id, message_id, role, content FROM msgs")
def conversation_history(spark, sf_dir):
    return corpus.history(_messages(spark, sf_dir))


@register("conversation_window", f"WITH {_CHAT_SQL} SELECT report_id, message_id, role, age FROM (SELECT *, row_number() OVER (PARTITION BY report_id "
          "ORDER BY message_id DESC) AS age FROM msgs) WHERE age <= 12")
def conversation_window(spark, sf_dir):
    return corpus.recent_window(_messages(spark, sf_dir), size=12).select("report_id", "message_id", "role", "age")


# --- rate limits ---

_RATE_SQL = """RECURSIVE req AS (SELECT {key} AS key, event_id AS request_id, epoch_us(ts) AS t_us, row_number() OVER (PARTITION BY {key} ORDER BY ts,
  event_id) AS i FROM events),
walk AS (SELECT key, request_id, t_us, i, t_us AS s, 1 AS hits FROM req WHERE i = 1 UNION ALL SELECT r.key, r.request_id, r.t_us, r.i,
  CASE WHEN w.s < r.t_us - {win} THEN r.t_us ELSE w.s END, CASE WHEN w.s < r.t_us - {win} THEN 1 ELSE w.hits + 1 END
  FROM walk w JOIN req r ON r.key = w.key AND r.i = w.i + 1)"""
_USER_KEY, _IP_KEY = "CAST(user_id AS STRING)", "CAST(user_id % 7 AS STRING)"
_DAY_MS = 86_400_000
_VERDICT = ("key, request_id, hits, hits <= {lim} AS allowed, greatest(0, {lim} - hits) AS remaining, CAST(floor((s + {win} - t_us) / 1000 + 0.5) "
            "AS BIGINT) AS reset_ms")


def _requests(spark, sf_dir, key):
    return table(spark, sf_dir, "events").selectExpr(f"{key} AS key", "event_id AS request_id", "ts")


def _rates(spark, sf_dir, key=_USER_KEY, limit=2, window=_DAY_MS):
    return limits.rate_limit(_requests(spark, sf_dir, key), limit, window)


@register("rate_limit", "WITH " + _RATE_SQL.format(key=_USER_KEY, win=_DAY_MS * 1000) + " SELECT " + _VERDICT.format(lim=2, win=_DAY_MS * 1000)
          + " FROM walk")
def rate_limit(spark, sf_dir):
    return _rates(spark, sf_dir).drop("window_start_us")


_STATE_SQL = "st AS (SELECT key, max(s) AS window_start_us, arg_max(hits, i) AS count FROM walk GROUP BY key)"
_NOW = "TIMESTAMP '2024-01-30 20:00:00'"


def _now():
    return F.lit(datetime(2024, 1, 30, 20))


@register("rate_peek", "WITH " + _RATE_SQL.format(key=_USER_KEY, win=_DAY_MS * 1000) + f", {_STATE_SQL} SELECT key, CASE WHEN window_start_us >= "
          f"epoch_us({_NOW}) - {_DAY_MS * 1000} THEN count ELSE 0 END AS count FROM st")
def rate_peek(spark, sf_dir):
    return limits.peek(limits.rate_state(_rates(spark, sf_dir)), _now(), _DAY_MS)


@register("rate_cleanup", "WITH " + _RATE_SQL.format(key=_USER_KEY, win=_DAY_MS * 1000) + f", {_STATE_SQL} SELECT key, window_start_us, count FROM st "
          f"WHERE window_start_us >= epoch_us({_NOW}) - 86400000000")
def rate_cleanup(spark, sf_dir):
    return limits.without_stale(limits.rate_state(_rates(spark, sf_dir)), _now())


@register("stricter_of_two", "WITH " + _RATE_SQL.format(key=_USER_KEY, win=_DAY_MS * 1000) + ", " + _RATE_SQL.format(
    key=_IP_KEY, win=3_600_000_000).replace("RECURSIVE req", "req2").replace("walk", "walk2").replace("FROM req ", "FROM req2 ").replace(
    "JOIN req ", "JOIN req2 ")
    + " SELECT u.request_id, CASE WHEN u.hits <= 2 THEN a.hits <= 3 ELSE false END AS allowed, CASE WHEN u.hits <= 2 THEN greatest(0, 3 - a.hits) ELSE "
    "0 END AS remaining, CASE WHEN u.hits <= 2 THEN CAST(floor((a.s + 3600000000 - a.t_us) / 1000 + 0.5) AS BIGINT) ELSE CAST(floor((u.s + "
    f"{_DAY_MS * 1000} - u.t_us) / 1000 + 0.5) AS BIGINT) END AS reset_ms FROM walk u JOIN walk2 a USING (request_id)")
def stricter_of_two(spark, sf_dir):
    return limits.stricter(_rates(spark, sf_dir), _rates(spark, sf_dir, _IP_KEY, 3, 3_600_000))


@register("daily_cap", f"""WITH RECURSIVE seq AS (SELECT event_id AS request_id, event_type = 'view' AS consumes, epoch_us(ts) AS t_us, row_number() OVER (
  ORDER BY ts, event_type = 'view', event_id) AS i FROM events),
walk AS (SELECT request_id, consumes, i, CASE WHEN consumes THEN t_us END AS s, CASE WHEN consumes THEN 1 ELSE 0 END AS n,
  CASE WHEN consumes THEN NULL ELSE 0 END AS used FROM seq WHERE i = 1
  UNION ALL SELECT q.request_id, q.consumes, q.i,
  CASE WHEN q.consumes AND (w.s IS NULL OR w.s < q.t_us - {_DAY_MS * 1000}) THEN q.t_us ELSE w.s END,
  CASE WHEN NOT q.consumes THEN w.n WHEN w.s IS NULL OR w.s < q.t_us - {_DAY_MS * 1000} THEN 1 ELSE w.n + 1 END,
  CASE WHEN q.consumes THEN NULL WHEN w.s >= q.t_us - {_DAY_MS * 1000} THEN w.n ELSE 0 END FROM walk w JOIN seq q ON q.i = w.i + 1)
SELECT request_id, used, used < 50 AS allowed FROM walk WHERE NOT consumes""")
def daily_cap(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), "ts", "event_type")
    return limits.daily_cap(ev.filter("event_type = 'view'"), ev.filter("event_type <> 'view'"), cap=50)


# --- lifecycle and ownership ---

@register("stuck_reports", f"WITH {_REPORT_SQL} SELECT report_id, CASE WHEN stuck THEN 'error' ELSE status END AS status, CASE WHEN stuck THEN "
          "coalesce(nullif(error, ''), 'Audit timed out - no result within the expected window') ELSE error END AS error FROM (SELECT *, status IN "
          "('queued', 'crawling', 'analyzing', 'embedding') AND created_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 MINUTE AS stuck FROM reports)")
def stuck_reports(spark, sf_dir):
    return access.stuck_to_error(_reports(spark, sf_dir), datetime(2024, 1, 20)).select("report_id", "status", "error")


@register("stale_flags", f"WITH {_REPORT_SQL} SELECT report_id, status NOT IN ('done', 'error') AND created_at <= TIMESTAMP '2024-01-20 00:00:00' - "
          "INTERVAL 4 MINUTE AS stale FROM reports")
def stale_flags(spark, sf_dir):
    return _reports(spark, sf_dir).select(
        "report_id", access.is_stale(F.col("status"), F.col("created_at"), datetime(2024, 1, 20)).alias("stale"))


_DOCS_SQL = ("docs AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'not-a-uuid' ELSE 'r' || CAST(doc_id AS STRING) END AS report_id, text FROM documents)")
_LEADS_SQL = ("leads AS (SELECT o_orderkey AS lead_id, o_orderdate AS created_at FROM orders)")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 10 = 0 THEN 'not-a-uuid' ELSE 'r' || CAST(doc_id AS STRING) END AS report_id")


def _leads(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS lead_id", "o_orderdate AS created_at")


@register("retention_purge", f"WITH {_REPORT_SQL}, {_DOCS_SQL}, {_LEADS_SQL} SELECT 'report' AS kind, report_id AS id FROM reports WHERE created_at >= "
          "TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 90 DAY UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR) FROM docs WHERE report_id NOT IN (SELECT "
          "report_id FROM reports WHERE created_at < TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 90 DAY) UNION ALL SELECT 'lead', CAST(lead_id AS VARCHAR) "
          "FROM leads WHERE created_at >= TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 365 DAY")
def retention_purge(spark, sf_dir):
    r, d, l = access.purge(_reports(spark, sf_dir), _docs(spark, sf_dir), _leads(spark, sf_dir), datetime(2024, 4, 10))
    row = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
    return row(r, "report", "report_id").unionByName(row(d, "document", "doc_id")).unionByName(row(l, "lead", "lead_id"))


_GONE = "gone AS (SELECT report_id FROM reports WHERE user_id = 7 AND status IN ('done', 'error'))"


@register("deleted_reports", f"WITH {_REPORT_SQL}, {_DOCS_SQL}, {_GONE}, m AS (SELECT conv_id * 1000 + turn AS message_id, 'r' || CAST(conv_id AS STRING) "
          "AS report_id FROM conversations), s AS (SELECT event_id AS step_id, 'r' || CAST(event_id AS STRING) AS report_id FROM events) SELECT 'documents' AS kind, "
          "count(*) AS kept FROM docs WHERE report_id NOT IN (FROM gone) UNION ALL SELECT 'reports', count(*) FROM reports WHERE report_id NOT IN (FROM gone) UNION "
          "ALL SELECT 'steps', count(*) FROM s WHERE report_id NOT IN (FROM gone) UNION ALL SELECT 'messages', count(*) FROM m WHERE report_id NOT IN (FROM gone)")
def deleted_reports(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    ids = reports.filter("status IN ('done', 'error')").select("report_id")
    steps = table(spark, sf_dir, "events").selectExpr("event_id AS step_id", "'r' || CAST(event_id AS STRING) AS report_id")
    messages = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 1000 + turn AS message_id", "'r' || CAST(conv_id AS STRING) AS report_id")
    out = access.delete_reports(ids, F.lit(7), _docs(spark, sf_dir), reports, steps, messages)
    parts = [df.agg(F.count("*").alias("kept")).select(F.lit(k).alias("kind"), "kept") for k, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_ERASED = "erased AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 60)"


@register("erased_accounts", f"WITH {_REPORT_SQL}, {_DOCS_SQL}, {_ERASED}, mine AS (SELECT report_id FROM reports WHERE user_id IN (FROM erased)), usage AS (SELECT "
          "user_id, strftime(ts, '%Y-%m') AS period FROM events GROUP BY ALL) SELECT 'documents' AS kind, count(*) AS kept FROM docs WHERE report_id NOT IN (FROM "
          "mine) UNION ALL SELECT 'reports', count(*) FROM reports WHERE user_id NOT IN (FROM erased) UNION ALL SELECT 'usage', count(*) FROM usage WHERE user_id "
          "NOT IN (FROM erased)")
def erased_accounts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    users = events.filter("event_type = 'error' AND value > 60").select("user_id").distinct()
    out = access.erase_users(users, {"documents": (_docs(spark, sf_dir), "doc_id")}, _reports(spark, sf_dir), limits.monthly_usage(events))
    parts = [out[k].agg(F.count("*").alias("kept")).select(F.lit(k).alias("kind"), "kept") for k in ("documents", "reports", "usage")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("account_export", f"WITH {_REPORT_SQL}, m AS (SELECT conv_id * 1000 + turn AS message_id, 'r' || CAST(conv_id AS STRING) AS report_id, role FROM "
          "conversations), usage AS (SELECT user_id, strftime(ts, '%Y-%m') AS period, count(*) AS count FROM events GROUP BY ALL) SELECT user_id, 'report' AS kind, "
          "report_id AS id, '{\"report_id\":\"' || report_id || '\",\"status\":\"' || status || '\"}' AS payload FROM reports UNION ALL SELECT r.user_id, 'message', "
          "CAST(message_id AS VARCHAR), '{\"report_id\":\"' || m.report_id || '\",\"message_id\":' || message_id || ',\"role\":\"' || role || '\"}' FROM m JOIN reports r "
          "USING (report_id) UNION ALL SELECT user_id, 'usage', period, '{\"period\":\"' || period || '\",\"count\":' || count || '}' FROM usage")
def account_export(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").selectExpr(
        "'r' || CAST(conv_id AS STRING) AS report_id", "conv_id * 1000 + turn AS message_id", "role")
    return access.account_export(_reports(spark, sf_dir).select("report_id", "user_id", "status"), messages,
                                 limits.monthly_usage(table(spark, sf_dir, "events")))


@register("owner_scope", f"WITH {_REPORT_SQL}, {_DOCS_SQL} SELECT doc_id, report_id, user_id AS owner FROM docs JOIN reports USING (report_id)")
def owner_scope(spark, sf_dir):
    return access.with_owner(_docs(spark, sf_dir), _reports(spark, sf_dir), "doc_id").select("doc_id", "report_id", "owner")


@register("owner_scope_one_user", f"WITH {_REPORT_SQL}, {_DOCS_SQL} SELECT doc_id, report_id FROM docs WHERE report_id IN (SELECT report_id FROM reports WHERE "
          "user_id = 7)")
def owner_scope_one_user(spark, sf_dir):
    return access.scoped(_docs(spark, sf_dir), _reports(spark, sf_dir), F.lit(7), "doc_id").select("doc_id", "report_id")


@register("history_list", f"WITH {_REPORT_SQL} SELECT user_id, report_id, pos, score_overall, grade FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "
          "created_at DESC, report_id) AS pos, CASE WHEN score_overall IS NULL THEN '?' WHEN score_overall >= 90 THEN 'A' WHEN score_overall >= 80 THEN 'B' WHEN "
          "score_overall >= 70 THEN 'C' WHEN score_overall >= 60 THEN 'D' ELSE 'F' END AS grade FROM reports WHERE created_at >= TIMESTAMP '2024-02-01 00:00:00' - "
          "INTERVAL 7 DAY) WHERE pos <= 100")
def history_list(spark, sf_dir):
    return access.history_list(_reports(spark, sf_dir), LATE, days=7, first=100).select("user_id", "report_id", "pos", "score_overall", "grade")


@register("newest_leads", "SELECT o_orderkey AS lead_id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def newest_leads(spark, sf_dir):
    return access.newest_leads(_leads(spark, sf_dir), first=200)


@register("latest_rows", f"WITH {_LOG_SQL} SELECT report_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM log GROUP BY report_id")
def latest_rows(spark, sf_dir):
    return access.latest_rows(_status_log(spark, sf_dir), "report_id", ["ts", "event_id"]).select("report_id", "status", "ts")


@register("merged_reports", f"WITH {_LOG_SQL} SELECT report_id, max((ts, event_id))[2] AS event_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM log GROUP BY report_id")
def merged_reports(spark, sf_dir):
    """The log as two writes into one report table, later rows first: what they share and what only one of them has."""
    rows = _status_log(spark, sf_dir).select("report_id", F.expr("(event_id DIV 40) % 2").alias("half"), "event_id", "status", "ts")
    path = shared_folder(spark, "report-table")
    for half in (1, 0, 1):
        sinks.merge_reports(rows.where(F.col("half") == half).drop("half"), path, ["ts", "event_id"])
    return spark.read.parquet(path).select("report_id", "event_id", "status", "ts")


# A run over all submitted sites: customers ask for audits of sites, some of which were never crawled.
from catalog.check_sql import DIMS, OVERALL, audit_query  # noqa: E402

@register("finished_reports", audit_query(
    "SELECT q.report_id, CASE WHEN overall IS NULL THEN 'error' ELSE 'done' END AS status, overall AS score_overall, CASE WHEN overall IS NULL THEN "
    "'No usable page content was scraped (the site may be unreachable or blocking crawlers).' END AS error FROM (SELECT DISTINCT report_id FROM crawl UNION "
    "ALL SELECT 'customer-' || CAST(c_custkey AS STRING) FROM customer) q LEFT JOIN graded USING (report_id)", DIMS, OVERALL))
def finished_reports(spark, sf_dir):
    asked = facts(spark, sf_dir).select("report_id").distinct().unionByName(
        table(spark, sf_dir, "customer").selectExpr("'customer-' || CAST(c_custkey AS STRING) AS report_id"))
    return access.finished_reports(asked, scoring.overall_scores(scoring.dimension_scores(results(spark, sf_dir))))


"""Streams over the event log, run to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.account_queries import _DAY_MS, _RATE_SQL, _REPORT_SQL, _USER_KEY, _VERDICT
from catalog.registry import once, register
from pageloom.operators.limits import micros
from pageloom.session import materialize, shared_folder
from pageloom.streaming.runner import file_stream, latest_emitted, limited_to_table, run_to_table
from pageloom.streaming.stateful import rate_limit_stream, watchdog_stream
from pageloom.streaming.steps import current_steps, report_state, step_feed, with_full_rows
from pageloom.workload import table

BATCHES = 4


def _stream(spark, sf_dir, late=False):
    """The event log as it would arrive: the table cut by time into files, one file per micro-batch; ``late``: every seventh event a batch late."""
    events = table(spark, sf_dir, "events")

    def staged() -> str:
        folder = shared_folder(spark, "events")
        edges = events.agg(F.percentile_approx(micros(F.col("ts")), [k / BATCHES for k in range(1, BATCHES)], 1000)).first()[0]
        slot = sum((micros(F.col("ts")) > e).cast("int") for e in edges)
        if late:
            slot = F.least(F.lit(BATCHES - 1), slot + (F.col("event_id") % 7 == 0).cast("int"))
        for k in range(BATCHES):  # one after the other: a file stream takes files in the order of their times
            events.filter(slot == k).coalesce(1).write.mode("append").parquet(folder)
        return folder

    return file_stream(spark, once(spark, sf_dir, f"events-{late}", ("events",), staged), events.schema, files_per_batch=1)


_CHANGE = {
    "report_id": "'u' || CAST(user_id AS STRING)",
    "id": "event_id % 5",
    "seq": "event_id",
    "step": "event_type",
    "status": "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'done' ELSE 'crawling' END",
    "score_overall": "CAST(floor(value) AS INT) % 101",
    "error": "CASE event_type WHEN 'error' THEN 'failed' END",
}
_CHANGES = "changes AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _CHANGE.items()) + " FROM events)"


def _changes(df):
    return df.selectExpr(*[f"{e} AS {n}" for n, e in _CHANGE.items()])


@register("stream_current_steps", f"WITH {_CHANGES} SELECT report_id, id, max(seq) AS seq, arg_max(step, seq) AS step, arg_max(status, seq) AS status FROM changes GROUP BY ALL")
def stream_current_steps(spark, sf_dir):
    rows = run_to_table(current_steps(step_feed(_changes(_stream(spark, sf_dir)))), "steps", mode="update")
    return latest_emitted(rows, ["report_id", "id"]).select("report_id", "id", "seq", "step", "status")


@register("stream_step_feed_one_report", f"WITH {_CHANGES} SELECT report_id, id, seq, step FROM changes WHERE report_id = 'u7'")
def stream_step_feed(spark, sf_dir):
    rows = run_to_table(step_feed(_changes(_stream(spark, sf_dir)), "u7"), "feed")
    return rows.select("report_id", "id", "seq", "step")


@register("stream_terminal_reports", f"WITH {_CHANGES}, st AS (SELECT report_id, arg_max(status, seq) AS status, max(seq) AS seq FROM changes GROUP BY 1), full_rows AS (SELECT 'u' || "
          "CAST(user_id AS STRING) AS report_id, count(*) AS n_events FROM events GROUP BY 1) SELECT report_id, status, seq, n_events FROM st JOIN full_rows USING (report_id) WHERE "
          "status IN ('done', 'error')")
def stream_terminal_reports(spark, sf_dir):
    """Full rows joined inside the stream, with events that come a batch after newer ones of their report."""
    full = materialize(table(spark, sf_dir, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("report_id")).agg(
        F.count("*").alias("n_events")), "full-reports")
    emitted = run_to_table(with_full_rows(report_state(_changes(_stream(spark, sf_dir, late=True))), full), "terminal", mode="update")
    return latest_emitted(emitted, ["report_id"]).where("n_events IS NOT NULL").select("report_id", "status", "seq", "n_events")


_LIMIT_SQL = "WITH " + _RATE_SQL.format(key=_USER_KEY, win=_DAY_MS * 1000) + " SELECT " + _VERDICT.format(lim=2, win=_DAY_MS * 1000) + " FROM walk"


@register("stream_rate_limit", _LIMIT_SQL)
def stream_rate_limit(spark, sf_dir):
    requests = _stream(spark, sf_dir).selectExpr(f"{_USER_KEY} AS key", "event_id AS request_id", "ts")
    return run_to_table(rate_limit_stream(requests, 2, _DAY_MS), "rates").drop("_batch", "window_start_us")


@register("stream_rate_limit_hot_keys", _LIMIT_SQL)
def stream_rate_limit_hot_keys(spark, sf_dir):
    """The same by batches through the segmented fold, where a key may hold a whole batch."""
    requests = _stream(spark, sf_dir).selectExpr(f"{_USER_KEY} AS key", "event_id AS request_id", "ts")
    return limited_to_table(requests, 2, _DAY_MS, "rates").drop("_batch", "window_start_us")


_RUN = {
    "report_id": "'r' || CAST(event_id DIV 3 AS STRING)",
    "status": "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'done' WHEN 'click' THEN 'queued' WHEN 'signup' THEN 'crawling' ELSE 'embedding' END",
}
_RUN_SQL = "runs AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _RUN.items()).replace("event_id DIV 3", "event_id // 3") + ", ts FROM events)"


@register("stream_watchdog", f"WITH {_RUN_SQL} SELECT report_id, 'error' AS status, 'Audit timed out - no result within the expected window' AS error FROM (SELECT report_id, "
          "min(ts) + INTERVAL 10 MINUTE AS deadline, min(ts) FILTER (status IN ('done', 'error')) AS closed FROM runs GROUP BY 1) WHERE coalesce(date_trunc('millisecond', closed) > "
          "date_trunc('millisecond', deadline), date_trunc('millisecond', deadline) <= (SELECT date_trunc('millisecond', max(ts)) FROM runs))")
def stream_watchdog(spark, sf_dir):
    """Reports of three changes each, some of which end a run in time, some too late, some never."""
    changes = _stream(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in _RUN.items()], "ts")
    return run_to_table(watchdog_stream(changes), "watchdog").drop("_batch")

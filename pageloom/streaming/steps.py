"""Live progress: current steps and report state from a change feed.

Changes are ``report_id, id, seq, step, status, progress, ts``; ``seq`` orders the changes of a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("done", "error")


def step_feed(changes: DataFrame, report_id: str | None = None) -> DataFrame:
    """Changes of one report, or of all."""
    return changes if report_id is None else changes.filter(F.col("report_id") == report_id)


def current_steps(changes: DataFrame) -> DataFrame:
    """Newest version of every step row. Works on a stream (update mode) and on a table; state is one row per step."""
    rest = [c for c in changes.columns if c not in ("report_id", "id")]
    newest = changes.groupBy("report_id", "id").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    return newest.select("report_id", "id", *[F.col(f"r.{c}").alias(c) for c in rest])


def report_state(changes: DataFrame) -> DataFrame:
    """Newest small columns of every report; older events never overwrite newer ones."""
    newest = changes.groupBy("report_id").agg(F.max_by(F.struct("status", "score_overall", "error", "seq"), "seq").alias("r"))
    return newest.select("report_id", "r.status", "r.score_overall", "r.error", "r.seq")


def with_full_rows(state: DataFrame, reports: DataFrame) -> DataFrame:
    """Report state with the columns of the full row, which are null until the status is terminal.

    Works inside a stream: the state is joined with the report table batch by batch, and only terminal states meet it. In update
    mode a batch emits each report that changed in it, so a report that is opened again takes its row back.
    """
    small = ("status", "score_overall", "error", "seq")
    full = reports.select(F.col("report_id").alias("full_id"), *[c for c in reports.columns if c not in ("report_id", *small)])
    meets = (F.col("report_id") == F.col("full_id")) & F.col("status").isin(*TERMINAL)
    return state.join(full, meets, "left").drop("full_id")

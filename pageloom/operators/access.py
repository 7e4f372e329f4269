"""Who sees what, what is kept how long, and what a table looks like after updates and deletes.

Deletes are rewrites: the rows that stay, found by anti-joins on small id tables. Ids are compared as text, so a
malformed one never fails a job.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.operators.scoring import grade
from pageloom.session import salted_join

# States of an unfinished run, and the two sentences stored with a failed one.
OPEN_STATES = ("queued", "crawling", "analyzing", "embedding")
TIMEOUT_TEXT = "Audit timed out - no result within the expected window"
NO_CONTENT_TEXT = "No usable page content was scraped (the site may be unreachable or blocking crawlers)."


def _id(df: DataFrame, column: str = "report_id") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("string"))


def scoped_reports(reports: DataFrame, user: Column) -> DataFrame:
    return reports.filter(F.col("user_id") == user)


def scoped(df: DataFrame, reports: DataFrame, user: Column, spread_by: str) -> DataFrame:
    """Rows of the reports a user owns."""
    own = _id(scoped_reports(reports, user).select("report_id"))
    return salted_join(_id(df), own, ["report_id"], "left_semi", spread_by)


def with_owner(df: DataFrame, reports: DataFrame, spread_by: str) -> DataFrame:
    """Every row with the user allowed to read it; rows of unknown reports belong to nobody and drop out."""
    owners = _id(reports.select("report_id", F.col("user_id").alias("owner")))
    return salted_join(_id(df), owners, ["report_id"], "inner", spread_by)


def stuck_to_error(reports: DataFrame, as_of: datetime, minutes: int = 10) -> DataFrame:
    """Reports still open after ``minutes`` become errors with a default message unless they carry one."""
    stuck = F.col("status").isin(*OPEN_STATES) & (F.col("created_at") < F.lit(as_of - timedelta(minutes=minutes)))
    return reports.withColumns({
        "error": F.when(stuck, F.coalesce(F.nullif("error", F.lit("")), F.lit(TIMEOUT_TEXT))).otherwise(F.col("error")),
        "status": F.when(stuck, "error").otherwise(F.col("status")),
    })


def is_stale(status: Column, created_at: Column, as_of: datetime, minutes: int = 4) -> Column:
    """No terminal status within ``minutes``."""
    return ~status.isin("done", "error") & (created_at <= F.lit(as_of - timedelta(minutes=minutes)))


def purge(reports: DataFrame, documents: DataFrame, leads: DataFrame, as_of: datetime) -> tuple[DataFrame, ...]:
    """Retention: reports and their documents live 90 days, leads 365. Documents of unknown reports stay."""
    old = _id(reports.filter(F.col("created_at") < F.lit(as_of - timedelta(days=90))).select("report_id"))
    return (
        reports.filter(F.col("created_at") >= F.lit(as_of - timedelta(days=90))),
        salted_join(_id(documents), old, ["report_id"], "left_anti", "doc_id"),
        leads.filter(F.col("created_at") >= F.lit(as_of - timedelta(days=365))),
    )


def delete_reports(
    ids: DataFrame, user: Column, documents: DataFrame, reports: DataFrame, steps: DataFrame, messages: DataFrame
) -> dict[str, DataFrame]:
    """Deletes the user's own reports among ``ids`` and everything that hangs on them, documents first."""
    gone = _id(scoped_reports(reports, user).select("report_id")).join(_id(ids), "report_id", "left_semi")
    keep = lambda df, by: salted_join(_id(df), gone, ["report_id"], "left_anti", by)
    return {"documents": keep(documents, "doc_id"), "reports": keep(reports, "report_id"),
            "steps": keep(steps, "step_id"), "messages": keep(messages, "message_id")}


def erase_users(users: DataFrame, tables: dict[str, tuple[DataFrame, str]], reports: DataFrame, usage: DataFrame) -> dict[
        str, DataFrame]:
    """Erases all rows of the users: per-report tables through their reports, then reports and usage.

    ``tables`` maps a name to (rows with ``report_id``, column to spread by).
    """
    gone = _id(salted_join(reports, users.select("user_id"), ["user_id"], "left_semi", "report_id").select("report_id"))
    out = {n: salted_join(_id(df), gone, ["report_id"], "left_anti", by) for n, (df, by) in tables.items()}
    out["reports"] = salted_join(reports, users.select("user_id"), ["user_id"], "left_anti", "report_id")
    out["usage"] = salted_join(usage, users.select("user_id"), ["user_id"], "left_anti", "period")
    return out


def account_export(reports: DataFrame, messages: DataFrame, usage: DataFrame) -> DataFrame:
    """Everything kept about each user as JSON rows ``(user_id, kind, id, payload)``; sorted by the writer."""
    owned = with_owner(messages, reports, "message_id")
    row = lambda df, user, kind, key: df.select(
        F.col(user).alias("user_id"), F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"),
        F.to_json(F.struct(*[c for c in df.columns if c not in ("owner", "user_id")])).alias("payload"))
    return (
        row(reports, "user_id", "report", "report_id")
        .unionByName(row(owned, "owner", "message", "message_id"))
        .unionByName(row(usage, "user_id", "usage", "period"))
    )


def score_pill(score: Column) -> Column:
    return F.when(score.isNull(), "?").otherwise(grade(score))


def history_list(reports: DataFrame, as_of: datetime, days: int, first: int) -> DataFrame:
    """The ``first`` newest reports of the last ``days`` per user, with the grade of the score."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "report_id")
    return (
        reports.filter(F.col("created_at") >= F.lit(as_of - timedelta(days=days)))
        .select("user_id", "report_id", "domain", "status", "score_overall", "created_at")
        .withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= first)
        .withColumn("grade", score_pill(F.col("score_overall")))
    )


def newest_leads(leads: DataFrame, first: int) -> DataFrame:
    return leads.orderBy(F.desc("created_at"), "lead_id").limit(first)


def latest_rows(log: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Last write wins: the newest version of each row (a partial aggregate, not a window)."""
    rest = [c for c in log.columns if c != key]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("r"))
    return newest.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def finished_reports(reports: DataFrame, scores: DataFrame) -> DataFrame:
    """Reports after an audit run: done with a score, or an error where no usable page came back."""
    joined = reports.join(scores.select("report_id", "overall"), "report_id", "left")
    done = F.col("overall").isNotNull()
    return joined.select(
        "report_id", F.when(done, "done").otherwise("error").alias("status"), F.col("overall").alias("score_overall"),
        F.when(~done, F.lit(NO_CONTENT_TEXT)).alias("error"))


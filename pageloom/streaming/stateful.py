"""Keyed state over streams: the rate limiter and the stuck-run watchdog.

A key's state has one owner, so its rows of a micro-batch go through one task; size the batches with the source's limits.
Where a key may hold most of a batch, ``runner.limited_to_table`` runs the batch operator, which splits hot keys, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pageloom.operators.access import OPEN_STATES, TIMEOUT_TEXT
from pageloom.operators.limits import RATE_SCHEMA, _FixedWindow, micros

ROWS_AT_ONCE = 100_000


def rate_limit_stream(requests: DataFrame, limit: int, window_ms: int, lateness: str = "0 seconds") -> DataFrame:
    """The fixed-window limiter on a stream of ``(key, request_id, ts)``; requests of a batch count in time order.

    A key's state goes when the watermark has passed the end of its window: whatever comes later opens a new one.
    A key's rows of a micro-batch are held as two arrays, of times and ids, to be sorted.
    """
    fold = _FixedWindow(limit, window_ms * 1000)

    def step(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else None
        waiting = [(b["at"].to_numpy(dtype=np.int64), b["request_id"].to_numpy(dtype=np.int64)) for b in batches]
        at, ids = (np.concatenate(x) for x in zip(*waiting, strict=True))
        order = np.lexsort((ids, at))
        for k in range(0, len(order), ROWS_AT_ONCE):
            part = order[k : k + ROWS_AT_ONCE]
            held, out = fold.emit(held, pd.DataFrame({"key": key[0], "request_id": ids[part], "at": at[part]}))
            yield out
        state.update(held)
        state.setTimeoutTimestamp(max(held[0] // 1000 + window_ms, state.getCurrentWatermarkMs()) + 1)

    rows = requests.select("key", "request_id", F.col("ts").cast("timestamp").alias("ts"), micros(F.col("ts")).alias("at")).withWatermark("ts", lateness)
    return rows.groupBy("key").applyInPandasWithState(
        step, RATE_SCHEMA, "window_start_us bigint, hits bigint", "append", GroupStateTimeout.EventTimeTimeout)


def watchdog_stream(
    reports: DataFrame, minutes: int = 10, lateness: str = "0 seconds", keep_minutes: int = 1440, buckets: int = 4096
) -> DataFrame:
    """Flips reports to 'error' that are still open ``minutes`` of event time after their first row.

    ``reports``: changes ``report_id, status, ts``. State is the deadline of each open report. A terminal status that comes in
    time ends it; one that comes later finds the report flagged. What is left then is a mark, so that late rows
    flag nothing twice, and the mark goes ``keep_minutes`` later. The outcome follows from event times, whatever the batches.

    Reports have a few rows each, so a Python call per report costs far more than its rows: state is kept per bucket of reports, as
    columns of ids, deadlines (-1: a mark) and the times they fall due, and a call judges a bucket's reports at once. A
    bucket holds the reports of the last ``keep_minutes`` over ``buckets``.
    """
    wait_ms, keep_ms, never = minutes * 60_000, keep_minutes * 60_000, np.iinfo(np.int64).max

    def step(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, deadlines, dues = state.get if state.exists else ([], [], [])
        held = pd.DataFrame({"deadline": np.array(deadlines, dtype=np.int64), "due": np.array(dues, dtype=np.int64)}, index=pd.Index(ids, dtype=object))
        floor = state.getCurrentWatermarkMs()
        after = max(floor + 1, floor + keep_ms)
        seen = [] if state.hasTimedOut else [_first_and_closed(rows, never) for rows in batches]
        rows = pd.concat(seen).groupby(level=0).min() if seen else pd.DataFrame({"first": [], "closed": []}, index=held.index[:0], dtype=np.int64)
        known = held["deadline"].reindex(rows.index, fill_value=never)
        # What is due times out: a mark is gone after this batch, a report without rows in it is flagged and becomes one.
        marks = (held["deadline"] < 0).to_numpy()
        due = (held["due"] <= floor).to_numpy() & (marks | ~held.index.isin(rows.index))
        flagged = due & ~marks
        late = [held.index[flagged]]
        held.loc[flagged, ["deadline", "due"]] = [-1, after]
        held = held[~due | flagged]
        # Rows of a mark count for nothing, an open report keeps its deadline, and a new one gets its own.
        rows, known = rows[known >= 0], known[known >= 0]
        deadline = known.where(known < never, rows["first"] + wait_ms)
        ended = rows["closed"] < never
        late.append(rows.index[ended & (rows["closed"] > deadline)])
        fresh = pd.DataFrame({"deadline": deadline.where(~ended, -1), "due": deadline.clip(lower=floor + 1).where(~ended, after)})
        held = pd.concat([held[~held.index.isin(fresh.index)], fresh])
        if len(held):
            state.update((held.index.tolist(), held["deadline"].tolist(), held["due"].tolist()))
            state.setTimeoutTimestamp(max(floor + 1, int(held["due"].min()) - 1))
        elif state.exists:
            state.remove()
        flags = np.concatenate([x.to_numpy(dtype=object) for x in late])
        if len(flags):
            yield pd.DataFrame({"id": flags, "status": "error", "error": TIMEOUT_TEXT})

    rows = reports.select(
        F.coalesce(F.concat(F.lit("="), F.col("report_id").cast("string")), F.lit("")).alias("id"), "status", F.col("ts").cast("timestamp").alias("ts"))
    return (
        rows.withWatermark("ts", lateness).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
        .groupBy("bucket").applyInPandasWithState(
            step, "id string, status string, error string", "ids array<string>, deadlines array<bigint>, dues array<bigint>", "append",
            GroupStateTimeout.EventTimeTimeout)
        .select(F.when(F.col("id") != "", F.expr("substr(id, 2)")).alias("report_id"), "status", "error")
    )


def _first_and_closed(rows: pd.DataFrame, never: int) -> pd.DataFrame:
    """Per report the time of its first row and of its first terminal one, ``never`` if there is none."""
    at = rows["ts"].to_numpy().astype("datetime64[ms]").astype(np.int64)
    closed = np.where(rows["status"].isin(OPEN_STATES).to_numpy(), never, at)
    return pd.DataFrame({"first": at, "closed": closed}).groupby(rows["id"].to_numpy()).min()

"""Credits, refunds, message caps and fixed-window rate limits."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.operators.folds import ordered_fold
from pageloom.session import salted_join

MONTHLY_AUDITS = 3
CHAT_MESSAGES = 5
CHAT_CEILING = 20


def period(ts: Column) -> Column:
    """Month key 'yyyy-MM' in UTC."""
    return F.date_format(ts, "yyyy-MM")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def monthly_usage(events: DataFrame) -> DataFrame:
    """Events per user and month."""
    return events.groupBy("user_id", period(F.col("ts")).alias("period")).agg(F.count("*").alias("count"))


class _Credits:
    """Counter 0..cap: a consume adds one below the cap (returns the count, else -1), a refund takes one off, not below 0.

    Each event is a map ``x -> min(high, max(low, x + step))``; maps of this form stay of this form when one follows the
    other, so any run of events is three numbers, and the maps up to each event come from a doubling scan over arrays.
    """

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def start(self, key: Any) -> int:
        return 0

    @staticmethod
    def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Rows (step, low, high) of the first maps followed by the second."""
        low, high = (np.clip(first[:, c] + second[:, 0], second[:, 1], second[:, 2]) for c in (1, 2))
        return np.stack([first[:, 0] + second[:, 0], low, high], axis=1)

    def _upto(self, rows: pd.DataFrame) -> np.ndarray:
        """The map of all events up to and with each one."""
        step = np.where(rows["kind"].to_numpy() == "consume", 1, -1)
        maps = np.stack([step, np.zeros(len(step), np.int64), np.full(len(step), self.cap)], axis=1)
        reach = 1
        while reach < len(maps):
            maps[reach:] = self._then(maps[:-reach].copy(), maps[reach:])
            reach *= 2
        return maps

    def summarize(self, rows: pd.DataFrame) -> tuple[int, int, int]:
        return tuple(map(int, self._upto(rows)[-1]))

    def merge(self, first: tuple[int, int, int], second: tuple[int, int, int]) -> tuple[int, int, int]:
        return tuple(map(int, self._then(np.array([first]), np.array([second]))[0]))

    def advance(self, state: int, summary: tuple[int, int, int]) -> int:
        step, low, high = summary
        return min(high, max(low, state + step))

    def emit(self, state: int, rows: pd.DataFrame) -> tuple[int, pd.DataFrame]:
        maps = self._upto(rows)
        after = np.clip(state + maps[:, 0], maps[:, 1], maps[:, 2])
        before = np.concatenate(([state], after[:-1]))
        out = rows[["event_id", "user_id", "period", "kind"]].copy()
        out["returned"] = np.where((rows["kind"].to_numpy() == "consume") & (after == before), -1, after)
        return int(after[-1]), out


def credit_ledger(events: DataFrame, cap: int | None = None) -> DataFrame:
    """Replays consumes and refunds ``(event_id, user_id, period, kind, ts)`` per user and month in order.

    A consume returns the new count, or -1 at the cap; a refund returns the count after it. The cap never exceeds the
    plan's.
    """
    cap = min(MONTHLY_AUDITS if cap is None else cap, MONTHLY_AUDITS)
    keyed = events.withColumn("account", F.concat_ws("|", F.col("user_id").cast("string"), "period"))
    return ordered_fold(keyed.select("account", "ts", "event_id", "user_id", "period", "kind"), "account",
                        ["ts", "event_id"], _Credits(cap),
                        "event_id bigint, user_id bigint, period string, kind string, returned int")


def refunds_on_error(status_log: DataFrame) -> DataFrame:
    """The first transition of each report into 'error': one refund in the month the report was created.

    A report that never left 'error' before its first row still counts once; ``min_by`` per report is a partial
    aggregate, so no report's log is ever gathered.
    """
    # The first error row is a transition by definition: no earlier row of the report is an error.
    errors = status_log.filter((F.col("status") == "error") & F.col("user_id").isNotNull())
    first = errors.groupBy("report_id").agg(
        F.min_by(F.struct("event_id", "user_id", "ts", "created_at"), F.struct("ts", "event_id")).alias("e"))
    return first.select("report_id", F.col("e.event_id").alias("event_id"), F.col("e.user_id").alias("user_id"),
                        period(F.col("e.created_at")).alias("period"), F.col("e.ts").alias("ts"),
                        F.lit("refund").alias("kind"))


def usage_view(usage: DataFrame, cap: int = MONTHLY_AUDITS) -> DataFrame:
    """Remaining credits and percent used."""
    used = F.col("count")
    return usage.withColumns({
        "remaining": F.greatest(F.lit(0), F.lit(cap) - used).cast("int"),
        "percent": F.least(F.lit(100), F.floor(used / F.lit(cap) * 100 + 0.5)).cast("int"),
    })


def chat_cap(messages: DataFrame, owners: DataFrame, cap: int | None = None) -> DataFrame:
    """Verdict per user message: its id if accepted, -1 over the cap, 0 if the sender does not own the report.

    ``messages``: ``report_id, message_id, user_id, role, content``; ``owners``: ``report_id, user_id``. Only the first
    ``cap`` messages per report are ever ranked (a limit before the shuffle); the rest compare their id with the last
    accepted one.
    """
    cap = min(CHAT_MESSAGES if cap is None else cap, CHAT_CEILING)
    asked = messages.filter(F.col("role") == "user")
    owned = owners.select("report_id", F.col("user_id").alias("owner"))
    judged = salted_join(asked, owned, ["report_id"], "left", "message_id").withColumn(
        "mine", F.coalesce(F.col("owner") == F.col("user_id"), F.lit(False)))
    first = Window.partitionBy("report_id").orderBy("message_id")
    last = (
        judged.filter("mine").select("report_id", "message_id")
        .withColumn("pos", F.row_number().over(first)).filter(F.col("pos") <= cap)
        .groupBy("report_id").agg(F.max("message_id").alias("last_accepted"))
    )
    out = salted_join(judged, last, ["report_id"], "left", "message_id")
    accepted = F.col("message_id") <= F.col("last_accepted")
    return out.select(
        "report_id", "message_id",
        F.when(~F.col("mine"), F.lit(0)).when(accepted, F.col("message_id")).otherwise(F.lit(-1)).cast("bigint").alias(
            "returned"),
        F.when(F.col("mine") & accepted, F.col("content")).alias("stored"),
    )


class _FixedWindow:
    """A window opens at the first hit and is replaced by the first hit later than its start plus its length.

    State: (window start, hits so far), times in microseconds. Where a run of hits takes a state depends only on which
    of its hits is the first to open a new window, so the summary is a step function: the latest incoming window end for
    each distinct outcome. A window that is open when the run begins ends within one length of the run's first hit, so
    the function has at most as many steps as there are hits in that one length of time, however long the run is.

    Rows may have a ``weight``, the hits that they stand for, and ``seen``, the time that a reset is counted from.
    """

    def __init__(self, limit: int, window_us: int) -> None:
        self.limit, self.window = limit, window_us

    def start(self, key: Any) -> None:
        return None

    def _steps(self, until: np.ndarray, starts: np.ndarray, counts: np.ndarray, n: int, last: int) -> tuple:
        """Steps that differ from the next one, up to the first that no incoming window can outlast."""
        keep = np.append((starts[1:] != starts[:-1]) | (counts[1:] != counts[:-1]), True)
        until, starts, counts = until[keep], starts[keep], counts[keep]
        used = int(np.searchsorted(until, last, side="right")) + 1
        return until[:used], starts[:used], counts[:used], n, last

    @staticmethod
    def _weights(rows: pd.DataFrame) -> np.ndarray:
        return rows["weight"].to_numpy(dtype=np.int64) if "weight" in rows else np.ones(len(rows), np.int64)

    def summarize(self, rows: pd.DataFrame) -> tuple:
        t = rows["at"].to_numpy(dtype=np.int64)
        n, before = len(t), np.concatenate(([0], np.cumsum(self._weights(rows))))
        nxt = np.append(np.searchsorted(t, t + self.window, side="right"), n)  # first hit that replaces hit i's window
        last = np.arange(n + 1)
        jump = nxt.copy()
        while True:  # pointer doubling to the last window opened by the chain from i
            live = jump < n
            if not live.any():
                break
            last = np.where(live, last[np.minimum(jump, n)], last)
            jump = np.where(live, jump[np.minimum(jump, n)], jump)
        final = last[:n]
        return self._steps(t, t[final], before[-1] - before[final], int(before[-1]), int(t[0]) + self.window)

    def merge(self, first: tuple, second: tuple) -> tuple:
        until, starts, counts, n, last = first
        until2, starts2, counts2, n2, _ = second
        i = np.searchsorted(until2, starts + self.window, side="right")
        moved, at = i < len(until2), np.minimum(i, len(until2) - 1)
        later = until2 > until[-1]
        return self._steps(np.append(until, until2[later]), np.append(np.where(moved, starts2[at], starts), starts2[later]),
                           np.append(np.where(moved, counts2[at], counts + n2), counts2[later]), n + n2, last)

    def advance(self, state: tuple[int, int] | None, summary: tuple) -> tuple[int, int]:
        until, starts, counts, n, _ = summary
        if state is None:
            return int(starts[0]), int(counts[0])
        end = state[0] + self.window
        # First hit strictly after the window's end, grouped by outcome.
        i = int(np.searchsorted(until, end, side="right"))
        if i >= len(until):
            return state[0], state[1] + n
        return int(starts[i]), int(counts[i])

    def walk(self, state: tuple[int, int] | None, t: np.ndarray, weights: np.ndarray | None = None) -> tuple[tuple[int, int] | None, np.ndarray, np.ndarray]:
        """Window start and hits so far at each hit: one step per window, not per hit."""
        n = len(t)
        upto = np.arange(n + 1) if weights is None else np.concatenate(([0], np.cumsum(weights)))
        starts, counts = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        i = 0
        while i < n:
            if state is None or t[i] > state[0] + self.window:
                state = (int(t[i]), 0)
            j = int(np.searchsorted(t, state[0] + self.window, side="right"))
            starts[i:j] = state[0]
            counts[i:j] = state[1] + upto[i + 1 : j + 1] - upto[i]
            state = (state[0], state[1] + int(upto[j] - upto[i]))
            i = j
        return state, starts, counts

    def emit(self, state: tuple[int, int] | None, rows: pd.DataFrame) -> tuple[tuple[int, int], pd.DataFrame]:
        t = rows["at"].to_numpy(dtype=np.int64)
        state, starts, counts = self.walk(state, t, self._weights(rows))
        t = rows["seen"].to_numpy(dtype=np.int64) if "seen" in rows else t
        out = rows[["key", "request_id"]].copy()
        out["hits"] = counts
        out["window_start_us"] = starts
        out["allowed"] = counts <= self.limit
        out["remaining"] = np.maximum(0, self.limit - counts)
        out["reset_ms"] = np.floor((starts + self.window - t) / 1000 + 0.5).astype(np.int64)
        return state, out[rows["asks"].to_numpy(dtype=bool)] if "asks" in rows else out


RATE_SCHEMA = ("key string, request_id bigint, hits bigint, window_start_us bigint, allowed boolean, remaining bigint, "
               "reset_ms bigint")


def rate_limit(requests: DataFrame, limit: int, window_ms: int, state: DataFrame | None = None) -> DataFrame:
    """Fixed-window limiter over ``(key, request_id, ts)``: verdict, budget left and milliseconds to the reset.

    Requests past the limit keep counting. The windows are anchored at each key's first hit, not on the clock. With
    ``state``, the counters ``(key, window_start_us, count)`` of earlier requests, their windows go on: a counter stands before
    its key's requests as one row of that many hits, and requests older than its window count in it.
    """
    rows = requests.select("key", "request_id", micros(F.col("ts")).alias("at"))
    if state is None:
        return ordered_fold(rows, "key", ["at", "request_id"], _FixedWindow(limit, window_ms * 1000), RATE_SCHEMA)
    held = state.select("key", "window_start_us", "count").join(rows.select("key").distinct(), "key", "left_semi")
    asked = salted_join(rows, held.select("key", "window_start_us"), ["key"], "left", "request_id").select(
        "key", "request_id", F.greatest("at", "window_start_us").alias("at"), F.col("at").alias("seen"), F.lit(1).cast("long").alias("weight"), F.lit(True).alias("asks"))
    carried = held.select("key", F.lit(0).cast("long").alias("request_id"), F.col("window_start_us").alias("at"), F.col("window_start_us").alias("seen"),
                          F.col("count").cast("long").alias("weight"), F.lit(False).alias("asks"))
    return ordered_fold(asked.unionByName(carried), "key", ["at", "asks", "request_id"], _FixedWindow(limit, window_ms * 1000), RATE_SCHEMA)


def rate_state(verdicts: DataFrame) -> DataFrame:
    """Counter per key after all requests."""
    return verdicts.groupBy("key").agg(
        F.max("window_start_us").alias("window_start_us"),
        F.max_by("hits", F.struct("window_start_us", "hits")).alias("count"))


def peek(state: DataFrame, now: Column, window_ms: int) -> DataFrame:
    """Hits in the active window, 0 if it has run out; consumes nothing."""
    active = F.col("window_start_us") >= F.unix_micros(now) - F.lit(window_ms * 1000)
    return state.select("key", F.when(active, F.col("count")).otherwise(F.lit(0)).alias("count"))


def without_stale(state: DataFrame, now: Column, days: int = 1) -> DataFrame:
    return state.filter(F.col("window_start_us") >= F.unix_micros(now) - F.lit(days * 86_400_000_000))


def stricter(per_user: DataFrame, per_address: DataFrame) -> DataFrame:
    """Both limits of a request; the user's failure is reported first."""
    cols = lambda df, p: df.select("request_id", *[F.col(c).alias(f"{p}_{c}") for c in
                                                   ("allowed", "remaining", "reset_ms")])
    both = cols(per_user, "u").join(cols(per_address, "a"), "request_id")
    pick = lambda c: F.when(F.col("u_allowed"), F.col(f"a_{c}")).otherwise(F.col(f"u_{c}"))
    return both.select("request_id", *[pick(c).alias(c) for c in ("allowed", "remaining", "reset_ms")])


def daily_cap(started: DataFrame, attempts: DataFrame, cap: int, window_ms: int = 86_400_000) -> DataFrame:
    """A global daily ceiling: an attempt passes while the window holds fewer than ``cap`` started audits.

    Both streams are one ordered sequence: starts consume, attempts only look. ``started`` and ``attempts`` hold
    ``request_id, ts``; an attempt sees the starts that come before it.
    """
    rows = started.select(F.lit("global").alias("key"), "request_id", micros(F.col("ts")).alias("at"), F.lit(True).alias(
        "consumes")).unionByName(attempts.select(F.lit("global").alias("key"), "request_id", micros(F.col("ts")).alias(
            "at"), F.lit(False).alias("consumes")))
    # Looks come before starts at the same instant.
    return ordered_fold(rows, "key", ["at", "consumes", "request_id"], _Gate(cap, window_ms * 1000),
                        "request_id bigint, used bigint, allowed boolean").filter(F.col("used").isNotNull())


class _Gate(_FixedWindow):
    """The same window, with rows that look at the counter without touching it. A summary is empty for a run of looks."""

    def summarize(self, rows: pd.DataFrame) -> tuple:
        starts = rows[rows["consumes"].astype(bool)]
        return super().summarize(starts) if len(starts) else ()

    def merge(self, first: tuple, second: tuple) -> tuple:
        return super().merge(first, second) if first and second else first or second

    def advance(self, state: Any, summary: tuple) -> Any:
        return super().advance(state, summary) if summary else state

    def emit(self, state: Any, rows: pd.DataFrame) -> tuple[Any, pd.DataFrame]:
        t, consumes = rows["at"].to_numpy(dtype=np.int64), rows["consumes"].to_numpy(dtype=bool)
        after, starts, counts = self.walk(state, t[consumes])
        none = -self.window - 1 if state is None else state[0]
        starts, counts = np.append(none, starts), np.append(0 if state is None else state[1], counts)  # before the first start
        seen = np.cumsum(consumes)
        open_now = (starts[seen] >= t - self.window) & (counts[seen] > 0)
        used = pd.array(np.where(open_now, counts[seen], 0), dtype="Int64")
        used[consumes] = pd.NA
        out = pd.DataFrame({"request_id": rows["request_id"].to_numpy(), "used": used})
        out["allowed"] = (out["used"] < self.limit).fillna(False).astype(bool)
        return after, out

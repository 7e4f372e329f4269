import pickle
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pageloom.operators import folds, limits

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events():
    """One key holds most rows, so it spans several segments."""
    rnd = random.Random(7)
    return [(i, 1 if rnd.random() < 0.7 else rnd.randrange(2, 30), T0 + timedelta(milliseconds=rnd.randrange(0, 2_000_000)),
             rnd.choice(["consume", "consume", "refund"])) for i in range(6000)]


@pytest.fixture(scope="module")
def frame(spark, events):
    return spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, kind string").repartition(8)


def in_order(events):
    return sorted(events, key=lambda e: (e[2], e[0]))


def test_credit_ledger(frame, events):
    got = {r.event_id: r.returned for r in limits.credit_ledger(frame.withColumn("period", limits.period(F.col("ts")))).collect()}
    held, want = {}, {}
    for i, user, _, kind in in_order(events):
        c = held.get(user, 0)
        new = min(c + 1, 3) if kind == "consume" else max(c - 1, 0)
        want[i] = -1 if kind == "consume" and new == c else new
        held[user] = new
    assert got == want


def test_cap_is_clamped(spark):
    df = spark.createDataFrame([(i, 1, T0 + timedelta(seconds=i), "consume", "2024-01") for i in range(4)],
                               "event_id long, user_id long, ts timestamp, kind string, period string")
    assert [r.returned for r in limits.credit_ledger(df, cap=999_999).orderBy("event_id").collect()] == [1, 2, 3, -1]


@pytest.mark.parametrize("limit,window", [(10, 60_000), (3, 700), (500, 900_000)])
def test_rate_limit(frame, events, limit, window):
    req = frame.selectExpr("cast(user_id as string) key", "event_id request_id", "ts")
    got = {r.request_id: (r.hits, r.allowed, r.remaining, r.reset_ms) for r in limits.rate_limit(req, limit, window).collect()}
    held, want, w = {}, {}, timedelta(milliseconds=window)
    for i, user, ts, _ in in_order(events):
        start, n = held.get(user, (None, 0))
        start, n = (ts, 1) if start is None or start < ts - w else (start, n + 1)
        held[user] = (start, n)
        want[i] = (n, n <= limit, max(0, limit - n), int((start + w - ts) / timedelta(milliseconds=1)))
    assert got == want


def test_eleventh_hit_is_blocked_and_the_window_reopens(spark):
    rows = [("a", i, T0 + timedelta(seconds=i)) for i in range(11)] + [("a", 11, T0 + timedelta(seconds=61)), ("b", 12, T0)]
    out = {r.request_id: r for r in limits.rate_limit(spark.createDataFrame(rows, "key string, request_id long, ts timestamp"), 10, 60_000).collect()}
    assert [out[i].allowed for i in range(13)] == [True] * 10 + [False, True, True]


def test_daily_cap_counts_only_started(frame, events):
    started = frame.filter("event_id % 2 = 0").selectExpr("event_id request_id", "ts")
    looks = frame.filter("event_id % 2 = 1").selectExpr("event_id request_id", "ts")
    got = {r.request_id: (r.used, r.allowed) for r in limits.daily_cap(started, looks, 60, 50_000).collect()}
    held, want, w = None, {}, timedelta(milliseconds=50_000)
    for i, _, ts, _ in sorted(events, key=lambda e: (e[2], e[0] % 2 == 0, e[0])):
        if i % 2 == 0:
            held = (ts, 1) if held is None or held[0] < ts - w else (held[0], held[1] + 1)
        else:
            used = held[1] if held and held[0] >= ts - w else 0
            want[i] = (used, used < 60)
    assert got == want


def test_refund_once_per_report(spark):
    log = spark.createDataFrame(
        [(1, "r", 5, T0, "queued"), (2, "r", 5, T0 + timedelta(1), "error"), (3, "r", 5, T0 + timedelta(2), "done"),
         (4, "r", 5, T0 + timedelta(3), "error"), (5, "q", 6, T0, "done")], "event_id long, report_id string, user_id long, ts timestamp, status string")
    out = limits.refunds_on_error(log.withColumn("created_at", F.lit(T0))).collect()
    assert [(r.report_id, r.event_id, r.period) for r in out] == [("r", 2, "2024-01")]


def test_chat_cap(spark):
    msgs = [("r", i, 1, "user", "m" * 5000) for i in range(1, 8)] + [("r", 8, 2, "user", "x"), ("r", 9, 1, "assistant", "y")]
    df = spark.createDataFrame(msgs, "report_id string, message_id long, user_id long, role string, content string")
    owners = spark.createDataFrame([("r", 1)], "report_id string, user_id long")
    out = {r.message_id: r for r in limits.chat_cap(df, owners).collect()}
    assert [out[i].returned for i in range(1, 9)] == [1, 2, 3, 4, 5, -1, -1, 0]
    assert len(out[1].stored) == 5000 and out[6].stored is None


def test_step_function_summary_matches_replay():
    rnd = random.Random(3)
    fold = limits._FixedWindow(5, 1000)
    for _ in range(200):
        t = sorted(rnd.randrange(0, 6000) for _ in range(rnd.randrange(1, 40)))
        rows = pd.DataFrame({"key": "k", "request_id": range(len(t)), "at": t})
        state = None if rnd.random() < 0.2 else (t[0] - rnd.randrange(0, 1500), rnd.randrange(1, 9))
        assert tuple(fold.advance(state, fold.summarize(rows))) == tuple(fold.emit(state, rows)[0])


def test_summaries_of_parts_make_that_of_the_whole():
    rnd = random.Random(11)
    window = limits._FixedWindow(5, 50)
    credits = limits._Credits(3)
    for _ in range(200):
        t = sorted(rnd.randrange(0, 400) for _ in range(rnd.randrange(2, 40)))
        kinds = [rnd.choice(["consume", "refund"]) for _ in t]
        rows = pd.DataFrame({"key": "k", "request_id": range(len(t)), "at": t, "kind": kinds})
        cut = rnd.randrange(1, len(t))
        parts = rows.iloc[:cut], rows.iloc[cut:]
        for start in [None, *[(t[0] - k, 2) for k in range(0, 60, 7)]]:
            whole, joined = window.summarize(rows), window.merge(*map(window.summarize, parts))
            want = window.walk(start, rows["at"].to_numpy())[0]
            assert window.advance(start, whole) == window.advance(start, joined) == want
        for count in range(4):
            by_row = count
            for kind in kinds:
                by_row = min(by_row + 1, 3) if kind == "consume" else max(by_row - 1, 0)
            assert credits.advance(count, credits.merge(*map(credits.summarize, parts))) == credits.advance(count, credits.summarize(rows)) == by_row


def test_a_summary_does_not_grow_with_the_length_of_a_run():
    """Ten times the hits after the first window: no longer summary; a credit run is three numbers whatever its length."""
    sizes = []
    for n in (2_000, 20_000):
        rows = pd.DataFrame({"at": range(0, n * 10, 10), "kind": ["consume"] * n})
        sizes.append(len(limits._FixedWindow(5, 1_000).summarize(rows)[0]))
        assert len(limits._Credits(3).summarize(rows)) == 3
    assert sizes[0] == sizes[1] <= 102


@pytest.mark.parametrize("run", [2, 3, 32])
def test_start_states_come_down_a_tree(spark, run):
    """Many segments of a hot key and short keys, in runs of any length: the states of a chain from the first segment on."""
    rnd = random.Random(run)
    fold = limits._FixedWindow(5, 900)
    rows, want = [], {}
    for key, segs in (("hot", range(70)), ("b", [3]), ("c", [30, 31, 33]), (None, [69])):
        state, at = None, 0
        for seg in segs:
            times = []
            for _ in range(rnd.randrange(1, 30)):
                at += rnd.randrange(0, 200)
                times.append(at)
            part = pd.DataFrame({"at": times})
            rows.append((seg, key, bytearray(pickle.dumps(fold.summarize(part)))))
            want[seg, key] = state
            state = fold.walk(state, part["at"].to_numpy())[0]
    frame = spark.createDataFrame(rows, "_seg int, key string, _summary binary").repartition(5)
    read = folds.start_states(frame, "key", "string", fold, 70, run)
    got = {(r["_seg"], r["key"]): pickle.loads(r["_state"]) for r in read.collect()}
    assert got == want

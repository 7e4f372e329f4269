import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pageloom.operators.limits import rate_limit
from pageloom.streaming.runner import file_stream, latest_emitted, limited_to_table, run_to_table
from pageloom.streaming.stateful import rate_limit_stream, watchdog_stream
from pageloom.streaming.steps import current_steps, report_state, with_full_rows

T0 = datetime(2024, 1, 1)


def write(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_rate_limit_state_crosses_batches(spark, tmp_path):
    schema = "key string, request_id long, ts timestamp"
    batches = [[("a", 10 * b + i, T0 + timedelta(seconds=10 * b + i)) for i in range(4)] for b in range(4)]
    write(spark, tmp_path / "in", batches, schema)
    stream = file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_batch=1)
    rows = run_to_table(rate_limit_stream(stream, 5, 15_000), "t")
    assert rows.select("_batch").distinct().count() == 4
    batch = rate_limit(spark.read.parquet(str(tmp_path / "in")), 5, 15_000)
    key = lambda df: sorted(map(tuple, df.select("request_id", "hits", "allowed", "reset_ms").collect()))
    assert key(rows) == key(batch)


def test_current_steps(spark, tmp_path):
    schema = "report_id string, id long, seq long, step string, status string"
    write(spark, tmp_path / "in", [[("r", 1, 1, "crawl", "running")], [("r", 1, 3, "crawl", "done"), ("r", 2, 2, "seo", "running")],
                                   [("r", 1, 2, "crawl", "running")]], schema)
    src = spark.read.parquet(str(tmp_path / "in")).schema
    rows = run_to_table(current_steps(file_stream(spark, str(tmp_path / "in"), src, files_per_batch=1)), "s", mode="update")
    out = {r.id: (r.status, r.seq) for r in latest_emitted(rows, ["report_id", "id"]).collect()}
    assert out == {1: ("done", 3), 2: ("running", 2)}  # an older change never overwrites a newer one


def test_watchdog(spark, tmp_path):
    schema = "report_id string, status string, ts timestamp"
    write(spark, tmp_path / "in", [[("slow", "queued", T0), ("ok", "crawling", T0)], [("ok", "done", T0 + timedelta(minutes=5))],
                                   [("late", "queued", T0 + timedelta(minutes=11))]], schema)
    src = spark.read.parquet(str(tmp_path / "in")).schema
    out = run_to_table(watchdog_stream(file_stream(spark, str(tmp_path / "in"), src, files_per_batch=1)), "w").collect()
    assert [(r.report_id, r.status) for r in out] == [("slow", "error")]


def test_watchdog_outcome_follows_event_times(spark, tmp_path):
    """A terminal status after the deadline comes too late even in the same batch; nothing is flagged twice; marks go."""
    schema = "report_id string, status string, ts timestamp"
    at = lambda m: T0 + timedelta(minutes=m)
    write(spark, tmp_path / "in", [[("a", "queued", at(0)), ("a", "done", at(11)), ("b", "queued", at(0)), ("b", "done", at(10))],
                                   [("a", "queued", at(12)), ("b", "crawling", at(13)), ("c", "crawling", at(13))],
                                   [("a", "crawling", at(40)), ("d", "done", at(41))], [("a", "queued", at(3000)), ("e", "done", at(3100))]], schema)
    src = spark.read.parquet(str(tmp_path / "in")).schema
    stream = file_stream(spark, str(tmp_path / "in"), src, files_per_batch=1)
    out = run_to_table(watchdog_stream(stream, keep_minutes=60), "w").collect()
    assert sorted(r.report_id for r in out) == ["a", "a", "c"]  # a second time only long after its mark has gone


def test_watchdog_judges_a_bucket_of_reports_at_once(spark, tmp_path):
    """Many reports, null among their ids, share a state; each ends by its own times, in the batches and at the end of the stream."""
    schema = "report_id string, status string, ts timestamp"
    rnd = random.Random(3)
    rows = [(None if r == 0 else f"r{r}", rnd.choice(["queued", "queued", "done", None]), T0 + timedelta(seconds=rnd.randrange(3600))) for r in range(400) for _ in range(3)]
    rows.sort(key=lambda x: x[2])
    write(spark, tmp_path / "in", [[("before", "done", T0 - timedelta(minutes=1))], *[rows[k : k + 300] for k in range(0, 1200, 300)]], schema)
    stream = file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_batch=1)
    query = watchdog_stream(stream, keep_minutes=10_000, buckets=5).writeStream.format("memory").queryName("flags").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    first, closed, wait = {}, {}, timedelta(minutes=10)
    for report, status, ts in rows:
        first.setdefault(report, ts)
        if status != "queued":
            closed.setdefault(report, ts)
    end = rows[-1][2]
    want = {r for r in first if (closed[r] > first[r] + wait if r in closed else first[r] + wait <= end)}
    out = [r.report_id for r in spark.table("flags").collect()]
    assert len(out) == len(set(out)) and set(out) == want and None in first
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 5


def test_limiter_forgets_keys_whose_window_is_over(spark, tmp_path):
    schema = "key string, request_id long, ts timestamp"
    batches = [[(f"k{b}", 10 * b + i, T0 + timedelta(minutes=b, seconds=i)) for i in range(3)] for b in range(5)]
    write(spark, tmp_path / "in", batches, schema)
    stream = file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_batch=1)
    query = rate_limit_stream(stream, 2, 20_000).writeStream.format("memory").queryName("limits").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    assert spark.table("limits").count() == 15
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_full_rows_are_joined_inside_the_stream(spark, tmp_path):
    """A batch emits full rows of what became terminal in it; older events that come late change nothing; a reopened report loses its row."""
    schema = "report_id string, seq long, status string, score_overall int, error string"
    write(spark, tmp_path / "in", [[("a", 1, "crawling", None, None), ("b", 2, "done", 50, None)], [("a", 4, "done", 70, None), ("b", 1, "crawling", None, None)],
                                   [("a", 3, "error", None, "late"), ("c", 5, "error", None, "no page")], [("b", 6, "queued", None, None), ("d", 7, "done", 1, None)]], schema)
    full = spark.createDataFrame([(k, f"{k}.example") for k in "abce"], "report_id string, domain string").withColumn("status", F.lit("old"))
    stream = file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_batch=1)
    rows = run_to_table(with_full_rows(report_state(stream), full), "full", mode="update")
    by_batch = {}
    for r in rows.collect():
        by_batch.setdefault(r._batch, {})[r.report_id] = (r.status, r.domain)
    batches = [by_batch[k] for k in sorted(by_batch)]
    assert len(batches) == 4 and batches[0] == {"a": ("crawling", None), "b": ("done", "b.example")}
    assert batches[1]["a"] == ("done", "a.example") and batches[2]["c"] == ("error", "c.example")
    assert batches[3] == {"b": ("queued", None), "d": ("done", None)}
    last = {r.report_id: (r.status, r.domain, r.seq) for r in latest_emitted(rows, ["report_id"]).collect()}
    assert last == {"a": ("done", "a.example", 4), "b": ("queued", None, 6), "c": ("error", "c.example", 5), "d": ("done", None, 7)}


def test_limiter_by_batches_with_a_hot_key(spark, tmp_path):
    """Counters go on from batch to batch, a hot key is split over tasks, late requests count in the open window, and old counters go."""
    schema = "key string, request_id long, ts timestamp"
    rnd = random.Random(6)
    batches = []
    for b in range(4):
        rows = [("hot", 10_000 * b + i, T0 + timedelta(milliseconds=rnd.randrange(60_000 * b, 60_000 * (b + 1)))) for i in range(3000)]
        rows += [(f"k{i % 7 + b}", 10_000 * b + 5000 + i, T0 + timedelta(seconds=60 * b + i)) for i in range(40)]
        batches.append(rows + [("hot", 10_000 * b + 9000, T0 + timedelta(seconds=60 * b - 3))])
    write(spark, tmp_path / "in", batches, schema)
    stream = file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_batch=1)
    got = {r.request_id: (r.hits, r.allowed, r.remaining, r.reset_ms) for r in limited_to_table(stream, 500, 25_000).collect()}
    held, want, w = {}, {}, timedelta(seconds=25)
    for rows in batches:
        for key, i, ts in sorted(rows, key=lambda r: (r[0], max(r[2], held[r[0]][0]) if r[0] in held else r[2], r[1])):
            start, n = held.get(key, (None, 0))
            start, n = (ts, 1) if start is None or start < ts - w else (start, n + 1)
            held[key] = (start, n)
            want[i] = (n, n <= 500, max(0, 500 - n), int((start + w - ts) / timedelta(milliseconds=1)))
        latest = max(ts for _, _, ts in rows)
        held = {k: v for k, v in held.items() if v[0] + w >= latest}
    assert got == want

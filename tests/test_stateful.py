"""Streams with timers and several states, against what the batch operators make of the same rows."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import rate, sessions
from tallyloom.streaming import live, stateful

EVENTS = "event_id string, source string, session_hash string, role string, ts_ms long"
S = 1_000_000


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drain(stream, out, checkpoint, mode="append"):
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out)
    else:
        q = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(out))
    q = q.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


@pytest.mark.parametrize("batches", [1, 4])
def test_segments_equal_the_batch_in_any_batching(spark, tmp_path, batches):
    rng = random.Random(2)
    rows = [(f"e{k}", "s", f"h{rng.randrange(3)}", rng.choice(["user", "assistant", "assistant", "synthetic_user"]), rng.randrange(300) * 1000) for k in range(90)]
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows.sort(key=lambda r: r[4] + rng.randrange(200_000))  # not in order, but never 10 minutes late
    cut = [rows[k * len(rows) // batches : (k + 1) * len(rows) // batches] for k in range(batches)]
    for k, part in enumerate([*cut, [("end", "s", "other", "user", 10_000_000)], [("end2", "s", "other", "user", 20_000_000)]]):
        write(spark, part, EVENTS, src)
        if k % 2 == 0 or k > len(cut) - 1:  # some batches hold two files, each run is a restart
            drain(stateful.session_segments(spark.readStream.schema(EVENTS).parquet(src)), out, cp, "update")
    wanted = sessions.segments(spark.createDataFrame(rows, EVENTS))
    key = lambda df: sorted(map(tuple, df.select("source", "session_hash", "segment", "first_ms", "last_ms").collect()))
    assert key(stateful.latest_segments(spark.read.parquet(out))) == key(wanted)


def test_sample_equals_live_samples(spark):
    rng = random.Random(3)
    intervals = []
    for k in range(40):
        end = rng.randrange(100, 400) * S + rng.choice([0, 0, 250_000])
        intervals.append((k, end - rng.choice([0, 0, 700_000, 5 * S, 90 * S]), end, rng.randrange(1, 500), "m"))
    df = spark.createDataFrame(intervals, "interval_id long, start_us long, end_us long, tokens long, model string")
    ticks = [t * S for t in range(90, 800, 13)]
    wanted = rate.live_samples(spark.createDataFrame([(t,) for t in ticks], "tick_us long"), df, df.select(F.col("end_us").alias("signal_us"))).collect()
    spans = [(a, b, n) for _, a, b, n, _ in intervals]
    for r in wanted:
        got = stateful.sample("h", r["tick_us"], spans, max((b for _, b, _ in spans if b <= r["tick_us"]), default=None))
        assert got.state == r["state"] and got.latest_us == r["latest_us"], (got, r)
        for c in ("tps", "tokens_180", "tokens_5", "tokens_1"):
            assert got[c] == (None if r[c] is None else pytest.approx(r[c])), (c, got, r)


def test_every_second_has_a_sample_also_when_nothing_arrives(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "host string, start_us long, end_us long, tokens long"
    now = int(time.time())
    write(spark, [("a", (now - 2) * S, (now - 1) * S, 360), ("b", (now - 400) * S, (now - 399) * S, 9)], schema, src)
    stream = stateful.second_samples(spark.readStream.schema(schema).parquet(src), stale_seconds=20)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(processingTime="1 second").start()
    try:
        deadline = time.time() + 90
        while time.time() < deadline:
            time.sleep(2)
            rows = spark.read.schema(stateful.SAMPLES).parquet(out).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
            if any(r["host"] == "a" and r["state"] == "stale" for r in rows):
                break
        held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        q.stop()
    by = {h: sorted((r["tick_us"] // S, r["state"], r["tokens_180"]) for r in rows if r["host"] == h) for h in "ab"}
    for h in "ab":
        ticks = [t for t, *_ in by[h]]
        assert ticks == list(range(ticks[0], ticks[0] + len(ticks))) and len(ticks) > 5  # each second once, none is left out
    states = [s for _, s, _ in by["a"]]
    assert states == ["live"] * states.count("live") + ["stale"] * states.count("stale") and states.count("live") > 3 and "stale" in states
    assert all(v == 360 for _, s, v in by["a"] if s == "live") and {s for _, s, _ in by["b"]} == {"stale"}
    assert held < 20  # what lies behind the window isn't kept


def test_late_rows_are_counted_in_the_scan_that_drops_them(spark, tmp_path):
    from tallyloom.operators import incremental

    schema = "id long, ts_ms long"
    rows = [(k, k * 10) for k in range(100)]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    kept, seen = incremental.drop_late_observed(spark.read.parquet(src), 300, future_ms=900)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan
    assert kept.count() == 60 and seen.get == {"late": 30, "future": 10, "kept": 60}
    stream, none = incremental.drop_late_observed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), 300, "late_rows")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    metrics = [p["observedMetrics"]["late_rows"] for p in q.recentProgress if "late_rows" in (p["observedMetrics"] or {})]
    assert none is None and sum(m["late"] for m in metrics) == 30 and sum(m["kept"] for m in metrics) == 70


def test_idle_seconds_are_zero_before_they_are_stale():
    spans = [(0, S, 50)]
    states = [stateful.sample("h", t * S, spans if t < 181 + 1 else [], S).state for t in (1, 100, 181, 182, 300, 301, 302)]
    assert states == ["live", "live", "zero", "zero", "zero", "zero", "stale"]


def test_counters_restart_warm_from_stored_state(spark, tmp_path):
    src, out, cp, saved, cp2, out2 = (str(tmp_path / x) for x in ("src", "out", "cp", "saved", "cp2", "out2"))  # a file sink knows batches by number, so each checkpoint has its own
    rows = lambda folder: spark.readStream.schema(live.COUNTER_ROWS).parquet(folder)
    write(spark, [("f", 1, 10 * S, 100, "m", None), ("f", 2, 20 * S, 160, None, None), ("g", 1, 5 * S, 7, None, None)], live.COUNTER_ROWS, src)
    drain(stateful.counter_stream(rows(src)), out, cp)
    state = stateful.stored_counters(spark, cp)
    assert sorted(map(tuple, state.collect())) == [("f", 160, 20 * S, "m"), ("g", 7, 5 * S, None)]
    state.write.parquet(saved)
    later = str(tmp_path / "later")  # a fresh checkpoint that sees new rows only
    write(spark, [("f", 3, 30 * S, 280, None, None), ("g", 2, 6 * S, 9, "x", None), ("new", 1, 6 * S, 50, "x", None), ("new", 2, 7 * S, 51, None, None)], live.COUNTER_ROWS, later)
    drain(stateful.counter_stream(rows(later), spark.read.parquet(saved)), out2, cp2)
    write(spark, [("f", 4, 40 * S, 281, None, None)], live.COUNTER_ROWS, later)
    drain(stateful.counter_stream(rows(later), spark.read.parquet(saved)), out2, cp2)  # the initial state counts once
    got = sorted((r["file_id"], r["start_us"] // S, r["end_us"] // S, r["tokens"], r["model"]) for r in spark.read.parquet(out).union(spark.read.parquet(out2)).collect())
    assert got == [("f", 10, 20, 60, "m"), ("f", 20, 30, 120, "m"), ("f", 30, 40, 1, "m"), ("g", 5, 6, 2, "x"), ("new", 6, 7, 1, "x")]
    after = {r["file_id"]: r["total"] for r in stateful.stored_counters(spark, cp2).collect()}
    assert after == {"f": 281, "g": 9, "new": 51}

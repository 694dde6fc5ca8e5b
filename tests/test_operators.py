"""Golden cases of the usage operators."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import code
from tallyloom.functions import exprs as X
from tallyloom.operators import calls, curves, dedup, incremental, rate, rollout, sessions, tasks, transcript, usage
from tallyloom.schemas import LINES, MAX_LONG, USAGE_EVENTS
from tallyloom.sources import lines as L
from tallyloom.sources import payloads
from tallyloom.sources.store import RawStore

T0 = "2026-01-05T10:00:%02dZ"


def lines(spark, rows, file_id="f1", source="codex"):
    return spark.createDataFrame([(file_id, source, k, r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(rows)], LINES)


def usage_of(inp, out, cached=0, creation=0, reasoning=0, total=None):
    return {"input_tokens": inp, "output_tokens": out, "cached_input_tokens": cached, "cache_creation_input_tokens": creation, "reasoning_output_tokens": reasoning, "total_tokens": inp + out if total is None else total}


def token(second, last=None, total=None, model=None):
    info = {k: v for k, v in (("last_token_usage", last), ("total_token_usage", total), ("model", model)) if v is not None}
    return {"timestamp": T0 % second if isinstance(second, int) else second, "type": "event_msg", "payload": {"type": "token_count", "info": info}}


def meta(rid, **more):
    return {"timestamp": T0 % 0, "type": "session_meta", "payload": {"id": rid, "cwd": "/home/u/proj", **more}}


def context(second, model, turn="t1"):
    return {"timestamp": T0 % second, "type": "turn_context", "payload": {"model": model, "turn_id": turn}}


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


# -- expressions -------------------------------------------------------------------------------


def test_rollout_algebra(spark):
    r = one(spark, X.rollout_counts(F.lit(100), F.lit(60), F.lit(0), F.lit(10), F.lit(30), F.lit(5), F.lit(130)).alias("c"))["c"]
    assert (r["input"], r["cached_input"], r["cache_creation"], r["output"], r["reasoning"]) == (30, 60, 10, 25, 5)


def test_saturation_and_reasoning_split(spark):
    df = spark.createDataFrame([(MAX_LONG,), (5,)], "n long")
    assert df.agg(X.saturating_sum("n").alias("s")).first()["s"] == MAX_LONG
    split = lambda t, o, n: one(spark, X.reasoning_split(F.lit(t), F.lit(o), F.lit(n)).alias("r"))["r"]
    assert [split(1, 1, 3), split(0, 9, 5), split(1, 0, 7), split(1, 2, 10), split(MAX_LONG // 2, MAX_LONG // 2, MAX_LONG)] == [2, 0, 7, 3, MAX_LONG // 2 + 1]


def test_day_bounds_follow_daylight_saving(spark):
    for day, hours in (("2024-03-10", 23), ("2024-11-03", 25), ("2024-06-01", 24)):
        a, b = X.day_bounds(F.to_timestamp(F.lit(f"{day} 20:00:00")), "America/Los_Angeles")
        assert one(spark, ((F.unix_micros(b) - F.unix_micros(a)) / 3_600_000_000).alias("h"))["h"] == hours


def test_times_maps_and_texts(spark):
    us = lambda t: one(spark, F.unix_micros(X.parse_time(F.lit(t))).alias("u"))["u"]
    assert us("2024-01-02T03:04:05.5Z") == 1704164645500000 and us("1704164645") == us("1704164645000") == us("2024-01-02T03:04:05+00:00") == 1704164645000000
    assert [us(x) for x in ("2024-01-02", "2024-01-02T03:04:05", "", "x", "2024-02-31T00:00:00Z")] == [None] * 5
    cut = lambda t, n: one(spark, X.truncate_utf8(F.lit(t), n).alias("t"))["t"]
    assert [cut("héllo", 2), cut("héllo", 3), cut("a€b", 3), cut("a😀b", 4), cut("abc", 3)] == ["h", "hé", "a", "a", "abc"]
    f = one(spark, X.tokens_text(F.lit(1234)).alias("a"), X.compact_tokens_text(F.lit(12_345)).alias("b"), X.compact_tokens_text(F.lit(100_000_000)).alias("c"), X.compact_tokens_text(F.lit(0)).alias("d"), X.percent_text(F.lit(0.123)).alias("e"), X.money_text(F.lit(123.4)).alias("f"), X.tokens_text(F.lit(None).cast("long")).alias("g"), X.mask_secret(F.lit("abcdefghijk")).alias("h"))
    assert tuple(f) == ("1.23K", "12K", "0.1B", "0.0K", "12.3%", "$123", X.DASH, "abcd****hijk")
    now = dt.datetime(2026, 1, 9)
    ages = spark.createDataFrame([(now - dt.timedelta(seconds=s),) for s in (5, 300, 7200, 200_000)], "t timestamp").select(X.age_text("t", F.lit(now)).alias("a")).collect()
    assert [r["a"] for r in ages] == ["just now", "5m ago", "2h ago", "2d ago"]


def test_cost_of_unlisted_model(spark):
    rows = spark.createDataFrame([("new-model", 1_000_000, 1_000_000, 1_000_000, 0)], "model string, input long, output long, cached_input long, reasoning long")
    prices = spark.createDataFrame([(1, "other", 1.0, 1.0, 1.0, 1.0)], "rank int, pattern string, input_price double, output_price double, cache_price double, reasoning_price double")
    assert usage.with_cost(rows, prices).first()["cost"] == pytest.approx(3 + 15 + 0.3)


# -- rollout files ---------------------------------------------------------------------------------


def test_rollout_last_usage_and_occurrences(spark):
    u = usage_of(100, 30, 60, 10, 5)
    ev = rollout.usage_events(rollout.parsed(lines(spark, [meta("r1"), context(1, "gpt-x"), token(2, u, u), token(3, u, u), "not json", token("bad", u, u), token(4, usage_of(0, 0))]))).orderBy("ts_ms").collect()
    assert len(ev) == 2 and ev[1]["event_id"] == ev[0]["event_id"] + "#1"
    assert (ev[0]["input"], ev[0]["cached_input"], ev[0]["cache_creation"], ev[0]["output"], ev[0]["reasoning"], ev[0]["total"]) == (30, 60, 10, 25, 5, 130)
    assert ev[0]["model"] == "gpt-x" and ev[0]["project"] == "proj" and ev[0]["lineage_fingerprint"] and ev[0]["dedup_key"].startswith("codex:") and not ev[0]["inherited"]
    assert ev[0]["session_hash"] == ev[0]["rollout_key"] == hashlib.sha256(b"r1").hexdigest()[:16]


def test_rollout_cumulative_fallback_with_reset(spark):
    rows = [meta("r"), context(1, "m"), token(2, total=usage_of(100, 10)), token(3, total=usage_of(150, 25)), token(4, total=usage_of(20, 5)), token(5, last=usage_of(7, 1)), token(6, total=usage_of(30, 6))]
    got = [(r["input"], r["output"]) for r in rollout.usage_events(rollout.parsed(lines(spark, rows))).orderBy("ts_ms").collect()]
    assert got == [(100, 10), (50, 15), (20, 5), (7, 1), (10, 1)]


def test_rollout_model_backfill_and_parents(spark):
    alone = rollout.usage_events(rollout.parsed(lines(spark, [meta("r"), token(1, usage_of(1, 1)), context(2, "late"), token(3, usage_of(2, 2), model="own")]))).orderBy("ts_ms").collect()
    assert [r["model"] for r in alone] == ["late", "own"]
    child = rollout.usage_events(rollout.parsed(lines(spark, [meta("c", parent_thread_id="p"), token(1, usage_of(1, 1), usage_of(1, 1)), context(2, "m"), token(3, usage_of(2, 2), usage_of(3, 3))]))).orderBy("ts_ms").collect()
    assert [(r["model"], r["inherited"]) for r in child] == [("unknown", True), ("m", False)]
    parent = rollout.usage_events(rollout.parsed(lines(spark, [meta("p"), context(0, "m"), token(1, usage_of(1, 1), usage_of(1, 1))]))).collect()
    assert child[0]["lineage_fingerprint"] == parent[0]["lineage_fingerprint"] != child[1]["lineage_fingerprint"]
    odd = rollout.parsed(lines(spark, [meta("c", parent_thread_id="p", forked_from_id="q"), token(1, usage_of(1, 1), usage_of(1, 1)), token("no", usage_of(1, 1))]))
    assert rollout.usage_events(odd).first()["lineage_fingerprint"] == ""
    assert sorted(r["message"] for r in rollout.diagnostics(odd).collect()) == ["line 3: invalid timestamp (usage skipped)", "session_meta: conflicting parent references; lineage replay disabled"]


def test_rollout_session_events_and_bad_lines(spark):
    ls = lines(spark, [meta("r"), context(1, "m"), token(2, usage_of(1, 1)), "{broken", {"type": "x"}])
    got = [(r["role"], r["ts_ms"]) for r in rollout.session_events(rollout.parsed(ls)).orderBy("ts_ms").collect()]
    assert [r for r, _ in got] == ["synthetic_user", "user", "assistant"]
    assert [r["message"] for r in L.invalid_lines(ls).collect()] == ["line 4: invalid json"]


# -- transcripts -----------------------------------------------------------------------------------


def answer(second, mid, usage=None, content=(), model="claude-x", **more):
    m = {"id": mid, "role": "assistant", "model": model, "content": list(content), **({"usage": usage} if usage else {})}
    return {"timestamp": T0 % second if isinstance(second, int) else second, "type": "assistant", "sessionId": "s1", "uuid": f"u{second}{mid}", "cwd": "/a/proj", "message": m, **more}


def test_transcript_folds_one_message(spark):
    u1, u2 = ({"input_tokens": 10, "output_tokens": n, "cache_read_input_tokens": 3} for n in (4, 9))
    rows = [answer(3, "m1", u1, [{"type": "thinking", "thinking": "aaaa"}]), answer(2, "m1", u2, [{"type": "text", "text": "bbbbb"}]), answer(2, "m1", u2, [{"type": "text", "text": "bbbbb"}]), answer(5, "m2", {"input_tokens": 1, "output_tokens": 2}, model="gpt")]
    ev = transcript.usage_events(transcript.rows_of(lines(spark, rows, source="claude"))).orderBy("ts_ms").collect()
    assert [(r["input"], r["output"], r["reasoning"], r["cached_input"], r["total"], r["model"]) for r in ev] == [(10, 5, 4, 3, 22, "claude-x"), (1, 2, 0, 0, 3, "gpt")]
    assert ev[0]["ts_ms"] % 60_000 == 2000 and ev[0]["merge_strategy"] == "overwrite"
    sub = transcript.usage_events(transcript.rows_of(lines(spark, rows, source="claude"), F.lit(True))).orderBy("ts_ms").first()
    assert (sub["output"], sub["reasoning"]) == (9, 0)


def test_transcript_counts_tools_once(spark):
    use = lambda n, i=None: {"type": "tool_use", "id": f"t{n}", "name": n, "input": i or {}}
    rows = [answer(1, "co", content=[use("mcp__files__read"), use("Skill", {"skill": "deploy"})]), answer(2, "co", content=[use("mcp__files__read")]), answer(3, "m", {"input_tokens": 1, "output_tokens": 1}, [use("mcp__git__log"), use("mcp__git__log")]), answer("nope", "x", content=[use("mcp__lost__x")])]
    ev = transcript.usage_events(transcript.rows_of(lines(spark, rows, source="claude"))).orderBy("ts_ms").collect()
    assert [(r["total"], r["mcp_counts"], r["skill_counts"], r["merge_strategy"]) for r in ev] == [(0, {"files": 1}, {"deploy": 1}, "cumulativeMax"), (2, {"git": 2}, {}, "overwrite")]


def test_transcript_edits_and_sessions(spark):
    edit = lambda i, path="a.py": {"type": "tool_use", "id": i, "name": "Edit", "input": {"file_path": path, "old_string": "x", "new_string": "y\nz"}}
    result = lambda i, bad=False: {"timestamp": T0 % 9, "type": "user", "sessionId": "s1", "uuid": f"r{i}", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": i, "is_error": bad}]}}
    person = {"timestamp": T0 % 0, "type": "user", "sessionId": "s1", "uuid": "p", "message": {"role": "user", "content": "hi"}}
    rows = transcript.rows_of(lines(spark, [person, answer(1, "m", content=[edit("ok"), edit("bad"), edit("open"), edit("gen", "dist/x.js")]), result("ok"), result("bad", True), result("gen"), person], source="claude"))
    assert [(r["tool_use_id"], r["added"], r["deleted"], r["project"]) for r in transcript.edit_entries(rows).collect()] == [("ok", 2, 1, "proj")]
    roles = [r["role"] for r in transcript.session_events(rows).orderBy("ts_ms").collect()]
    assert roles == ["user", "assistant", "synthetic_user", "synthetic_user", "synthetic_user"]


# -- dedup and sessions ----------------------------------------------------------------------------


def raw(spark, rows):
    base = {"event_id": "e", "source": "codex", "model": "m", "project": "p", "ts_ms": 1, "input": 0, "output": 0, "cached_input": 0, "cache_creation": 0, "reasoning": 0, "total": 0, "session_hash": "s", "file_id": "f", "rollout_key": "", "parent_rollout_key": "", "inherited": False, "has_total_snapshot": True, "lineage_fingerprint": "", "dedup_key": "", "merge_strategy": "overwrite", "skill_counts": {}, "mcp_counts": {}, "hostname": "h"}
    names = [c.split()[0] for c in USAGE_EVENTS.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], USAGE_EVENTS).withColumn("tier", F.lit(2))


def test_lineage_fold_prefers_own_rows_and_keeps_largest_maps(spark):
    rows = [{"event_id": "a", "ts_ms": 1, "inherited": True, "lineage_fingerprint": "L", "input": 5, "total": 5, "skill_counts": {"review": 2, "child": 1}}, {"event_id": "b", "ts_ms": 2, "lineage_fingerprint": "L", "input": 5, "total": 5, "skill_counts": {"review": 3}}, {"event_id": "c", "ts_ms": 3, "input": 10, "total": 10, "skill_counts": {"build": 1}}]
    got = {r["event_id"]: r for r in dedup.lineage_fold(dedup.tier_dedup(raw(spark, rows))).collect()}
    assert set(got) == {"b", "c"} and got["b"]["skill_counts"] == {"review": 3, "child": 1} and sum(r["input"] for r in got.values()) == 15
    assert dedup.unprovable_inherited(raw(spark, [{"inherited": True}])).first()["rows"] == 1


def test_content_fold_keeps_the_larger_copy(spark):
    rows = [{"event_id": "a", "ts_ms": 1, "dedup_key": "k", "input": 600, "total": 620, "output": 20}, {"event_id": "b", "ts_ms": 2, "dedup_key": "k", "input": 1100, "output": 100, "total": 1200}, {"event_id": "c", "ts_ms": 3, "dedup_key": "k", "input": 1100, "output": 100, "total": 1200}]
    got = dedup.content_fold(dedup.lineage_fold(dedup.tier_dedup(raw(spark, rows)))).collect()
    assert [(r["event_id"], r["total"]) for r in got] == [("b", 1200)]


def test_dedup_does_not_depend_on_row_order(spark):
    rng = random.Random(1)
    rows = [{"event_id": f"e{rng.randrange(9)}", "ts_ms": rng.randrange(5), "file_id": f"f{k}", "input": rng.randrange(99), "lineage_fingerprint": rng.choice(["", "x", "y"]), "dedup_key": rng.choice(["", "k"]), "inherited": rng.random() < 0.5, "model": rng.choice(["unknown", "a", "b"])} for k in range(40)]
    run = lambda rs: sorted(map(str, dedup.content_fold(dedup.lineage_fold(dedup.tier_dedup(raw(spark, rs)))).select("event_id", "input", "model", "ts_ms", "file_id", "copies").collect()))
    first = run(rows)
    for _ in range(2):
        rng.shuffle(rows)
        assert run(rows) == first


def test_session_golden(spark):
    ev = [("u", "user", 0), ("a", "assistant", 10), ("b", "assistant", 40), ("v", "user", 60), ("c", "assistant", 90), ("x", "synthetic_user", 120)]
    df = spark.createDataFrame([(i, "s", "h", r, t * 1000, "f", "") for i, r, t in ev], "event_id string, source string, session_hash string, role string, ts_ms long, file_id string, hostname string")
    r = sessions.normalise_session(sessions.session_aggregate(df)).first()
    assert (r["active_seconds"], r["user_message_count"], r["assistant_events"], r["message_count"], r["hour_histogram"][0], len(r["hour_histogram"])) == (30, 2, 3, 6, 6, 24)


# -- rates and curves ------------------------------------------------------------------------------


def window(spark, tick, start, end, tokens, f=rate.tokens_in_window):
    iv = spark.createDataFrame([(1, int(start * 1e6), int(end * 1e6), tokens, None)], "interval_id long, start_us long, end_us long, tokens long, model string")
    r = f(spark.createDataFrame([(int(tick * 1e6),)], "tick_us long"), iv).first()
    return r["tokens"] if r else None


def test_rate_golden(spark):
    assert [window(spark, t, 1000, 1000, 180) for t in (1000, 1180, 1180.001, 995, 994.9)] == [180, 180, None, 180, None]
    assert window(spark, 10_600, 10_000, 10_600, 6000) == 1800
    assert window(spark, 100, 99, 99, 7, rate.tokens_in_last_second) is None and window(spark, 100, 99.5, 99.5, 7, rate.tokens_in_last_second) == 7
    assert window(spark, 100, 98, 100, 7, rate.tokens_in_last_second) == 3.5


def test_overlap_equals_nested_loop(spark):
    rng = random.Random(3)
    iv = [(k, s := rng.randrange(5_000_000_000), s + rng.choice([0, 1, 10**6, 4 * 10**8]), rng.randrange(1, 99), "m") for k in range(150)]
    tk = sorted({rng.randrange(5_400_000_000) for _ in range(60)})
    got = rate.overlaps(spark.createDataFrame([(t,) for t in tk], "tick_us long"), spark.createDataFrame(iv, "interval_id long, start_us long, end_us long, tokens long, model string"), 180).select("tick_us", "interval_id").collect()
    want = {(t, k) for t in tk for k, s, e, *_ in iv if s <= t + 5_000_000 and e >= t - 180_000_000}
    assert len(got) == len(set(got)) and set(map(tuple, got)) == want


def test_dense_pairs_make_small_files_and_are_not_dealt_by_bytes(spark, tmp_path):
    """Ticks of one block come together for each interval; a second with many of both is many pairs and few bytes."""
    rng = random.Random(9)
    iv = [(k, s := rng.randrange(900_000_000), s + rng.choice([0, 40_000_000, 99_000_000])) for k in range(3000)] + [(-1, None, 5), (-2, 9, None), (-3, 400_000_000, 100_000_000)]
    tk = [(rng.randrange(-100_000_000, 1_000_000_000), "x") for _ in range(1500)] + [(None, "x"), (7, "y"), (7, "y")]
    ticks = spark.createDataFrame(tk, "tick_us long, note string").repartition(4)
    got = rate.overlaps(ticks, spark.createDataFrame(iv, "interval_id long, start_us long, end_us long").repartition(4), 180)
    assert got.columns == ["tick_us", "note", "interval_id", "start_us", "end_us"]
    want = sorted((t, n, k) for t, n in tk if t is not None for k, s, e in iv if s is not None and e is not None and s <= t + 5_000_000 and e >= t - 180_000_000)
    assert sorted(map(tuple, got.select("tick_us", "note", "interval_id").collect())) == want
    no_broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got.select("tick_us", "interval_id").write.parquet(f"{tmp_path}/pairs")
        assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", no_broadcast)
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 0.6 * len(want)


def test_windows_equal_the_pairs_sums_without_a_row_a_pair(spark):
    rng = random.Random(5)
    length = lambda: rng.choice([0, 1, 3_000_000, 70_000_000, 4 * 10**8])
    iv = [(k, s := rng.randrange(3_000_000_000), s + length(), rng.randrange(1, 99), rng.choice(["a", "b", None])) for k in range(400)] + [(999, 7, 7, 0, "a")]
    tk = [rng.randrange(3_400_000_000) for _ in range(150)] + [iv[0][2], iv[1][1] + 180_000_000]
    ticks, df = spark.createDataFrame([(t,) for t in tk + tk[:9]], "tick_us long"), spark.createDataFrame(iv, "interval_id long, start_us long, end_us long, tokens long, model string")

    def brute(seconds, slack, rounded):
        out = {}
        for t in set(tk):
            lo, hi = t - seconds * 1_000_000, t + slack * 1_000_000
            for _, s, e, n, m in iv:
                if n > 0 and s <= hi and e >= lo and (rounded or e > s or e > lo):
                    share = n * min(1.0, (min(e, hi) - max(s, lo)) / (e - s)) if e > s else float(n)
                    share = float(math.floor(share) + (share - math.floor(share) >= 0.5)) if rounded else share
                    if share > 0:
                        out[t, m or "unknown"] = out.get((t, m or "unknown"), 0.0) + share
        return out

    for f, args in ((rate.tokens_in_window, (180, 5, True)), (rate.tokens_in_short_window, (5, 5, True)), (rate.tokens_in_last_second, (1, 0, False))):
        want = brute(*args)
        got = {(r["tick_us"], r["model"]): r["tokens"] for r in f(ticks, df, by_model=True).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
        both = {r["tick_us"]: r["tokens"] for r in f(ticks, df).collect()}
        assert both.keys() == {t for t, _ in want} and all(abs(both[t] - sum(v for (u, _), v in want.items() if u == t)) < 1e-6 for t in both)
        assert "Join" not in f(ticks, df)._jdf.queryExecution().optimizedPlan().toString()


def test_live_states(spark):
    ticks = spark.createDataFrame([(int(t * 1e6),) for t in (5, 100, 250, 500, 90_000)], "tick_us long")
    iv = spark.createDataFrame([(1, 100_000_000, 100_000_000, 180, "m")], "interval_id long, start_us long, end_us long, tokens long, model string")
    got = rate.live_samples(ticks, iv, spark.createDataFrame([(100_000_000,), (300_000_000,)], "signal_us long")).orderBy("tick_us").collect()
    assert [(r["state"], r["tps"]) for r in got] == [("no_data", None), ("live", 1.0), ("live", 1.0), ("zero", 0.0), ("stale", None)]
    m = one(spark, rate.scaled_models(F.create_map(F.lit("a"), F.lit(3.0), F.lit("b"), F.lit(1.0)), F.lit(2.0)).alias("m"))["m"]
    assert m == {"a": 1.5, "b": 0.5}


def series(spark, values, key=None):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(values)], "idx long, value double")


def test_curves_against_plain_python(spark):
    rng = random.Random(4)
    vals = [None if rng.random() < 0.25 else rng.uniform(0, 9) for _ in range(60)]
    w = curves.smoothing_weights(2)
    runs, want = [], [None] * len(vals)
    for k, v in enumerate(vals):
        if v is not None:
            runs.append([k]) if not runs or runs[-1][-1] != k - 1 else runs[-1].append(k)
    for run in runs:
        for k in run:
            near = [(w[abs(j - k)], vals[j]) for j in run if abs(j - k) < len(w)]
            want[k] = sum(a * b for a, b in near) / sum(a for a, _ in near)
    got = [r["value"] for r in curves.gaussian(series(spark, vals), 2).orderBy("idx").collect()]
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got, want))
    filled = [r["value"] for r in curves.interpolate(series(spark, [None, 1, None, None, 4, None])).orderBy("idx").collect()]
    assert filled == [1, 1, 2, 3, 4, 4]
    assert [r["value"] for r in curves.interpolate(series(spark, [None, None])).collect()] == [None, None]
    assert [r["value"] for r in curves.ema(series(spark, [2, 4, None, 8]), 0.5).orderBy("idx").collect()] == [2, 3, None, 8]


def test_trends(spark):
    trend = lambda vals: curves.regression(series(spark, vals).withColumn("x", F.col("idx").cast("double"))).first()["trend"]
    assert [trend([1, 2, 3]), trend([10 - 0.125 * k for k in range(16)]), trend([10, 6, 2]), trend([5, 5]), trend([None, 3])] == ["rising", "flat", "falling", "flat", "insufficient"]


def test_resample_ties_keep_the_earliest(spark):
    pts = spark.createDataFrame([(8_000_000, 1.0), (12_000_000, 2.0), (14_999_999, 3.0), (20_000_000, None)], "at_us long, value double")
    assert [r["value"] for r in curves.resample(pts, 20_000_000, 20, 10).orderBy("idx").collect()] == [None, 1.0, None]


# -- maintenance, sinks and sources ---------------------------------------------------------------


def derived(spark, rows):
    return spark.createDataFrame(rows, "k string, bucket_start_ms long, total long, revision long, synced_revision long")


def test_recompute_is_idempotent_and_ack_never_covers_a_newer_revision(spark):
    old = derived(spark, [("a", 100, 5, 1, 1), ("b", 100, 6, 1, 0), ("z", 10, 1, 1, 1)])
    new = spark.createDataFrame([("a", 100, 5), ("b", 100, 7), ("c", 100, 8)], "k string, bucket_start_ms long, total long")
    out, changes = incremental.recompute(old, new, ["k", "bucket_start_ms"], ["total"], 1, 50)
    assert {r["k"]: (r["total"], r["revision"], r["synced_revision"]) for r in out.collect()} == {"a": (5, 1, 1), "b": (7, 2, 0), "c": (8, 2, 0), "z": (1, 1, 1)}
    again, changes = incremental.recompute(out, new, ["k", "bucket_start_ms"], ["total"], 2, 50)
    assert {r["change"] for r in changes.collect()} == {"unchanged"} and sorted(again.collect()) == sorted(out.collect())
    acked = {r["k"]: r["synced_revision"] for r in incremental.acknowledge(out, old.where("k = 'b'"), ["k"]).collect()}
    assert acked["b"] == 0
    page = incremental.pending(out, ["k"], 1).collect()
    assert [(r["k"], r["has_more"]) for r in page] == [("b", True)]


def test_files_and_freezing(spark):
    f = spark.createDataFrame([("a", "s", "complete"), ("b", "s", "degraded")], "file_id string, source string, status string")
    day = 86_400_000
    assert incremental.advance_frozen(0, 100 * day, f, False) == 0 and incremental.advance_frozen(0, 100 * day, f.where("file_id = 'a'"), False) == 70 * day
    assert incremental.advance_frozen(80 * day, 100 * day, f.where("file_id = 'a'"), False) == 80 * day and incremental.advance_frozen(0, 100 * day, f.limit(0), True) == 0
    marked = {r["file_id"]: r["status"] for r in incremental.mark_missing(f, f.where("file_id = 'a'"), "s").collect()}
    assert marked == {"a": "complete", "b": "missing"}
    with pytest.raises(ValueError):
        incremental.keep_newest(f, -1)


def test_wait_cells_resolve_their_first_call(spark):
    rows = [("f", 1, "call", "c1", None, None), ("f", 2, "output", "c1", "7", "running"), ("f", 3, "wait", "w1", "7", None), ("f", 4, "output", "w1", "7", "running"), ("f", 5, "wait", "w2", "7", None), ("f", 6, "output", "w2", None, "completed"), ("f", 7, "call", "c2", None, None), ("f", 8, "output", "c2", None, "failed"), ("f", 9, "call", "c3", None, None), ("f", 10, "wait", "w9", "99", None)]
    got = calls.resolved_calls(spark.createDataFrame(rows, "file_id string, line_no long, kind string, call_id string, cell_id string, state string")).collect()
    assert {r["call_id"]: r["done"] for r in got} == {"c1": True, "c2": False}


def test_udfs_run_on_columns(spark):
    df = spark.createDataFrame([("Edit", '{"old_string":"a","new_string":"b"}', "*** Begin Patch\n*** Update File: a\n+x", "\n Script completed\nx", '{"b":1,"a":[2]}', "tools.mcp__a__b()")], "n string, a string, p string, o string, j string, s string")
    r = df.select(code.edit_lines("n", "a").alias("e"), code.patch_lines("p").alias("p"), code.exec_applied("o").alias("x"), code.canonical_json("j").alias("j"), code.script_tools("s").alias("s"), code.mcp_worked("o").alias("w"), code.running_cell(F.lit("Script running with cell ID 42")).alias("c"), code.text_diff("n", "a").alias("d"), code.skill_reads("a").alias("k"), code.script_patch_body("s").alias("b"), code.programmatic_state("o").alias("st")).first()
    assert (r["e"]["added"], r["p"]["added"], r["x"], r["j"], r["s"], r["w"], r["c"], r["d"]["added"], r["k"], r["b"], r["st"]) == (1, 1, True, '{"a":[2],"b":1}', {"a": 1}, True, "42", 1, {}, None, "completed")


def test_payloads(spark):
    b = spark.createDataFrame([(0, 1, "s", "<a&b>", 5, 0, {}), (0, 2, "s", "m", 6, 7, {"k": 1}), (1, 3, "s", "m", 1, 1, {})], "batch int, n int, source string, model string, total long, output long, mcp_counts map<string,bigint>")
    got = {r["batch"]: r["body"] for r in payloads.envelopes(b, ["source", "model", "total"], ["output", "mcp_counts"]).collect()}
    assert got[0] == '{"buckets":[{"source":"s","model":"\\u003ca\\u0026b\\u003e","total":5},{"source":"s","model":"m","total":6,"output":7,"mcp_counts":{"k":1}}]}'
    s = payloads.session_payloads(spark.createDataFrame([(1000, 3999)], "first_ms long, last_ms long")).first()
    assert (s["first_at"], s["duration_seconds"]) == ("1970-01-01T00:00:01Z", 2)
    assert payloads.normalise_wire(spark.createDataFrame([("x" * 40, "m")], "source string, model string"), "h").first().asDict() == {"source": "x" * 30, "model": "m", "hostname": "h"}


def test_sources(spark, tmp_path):
    (tmp_path / "a/subagents").mkdir(parents=True)
    (tmp_path / "a/x.jsonl").write_text('{"a":1}\n\n{"b":2}\n')
    (tmp_path / "a/subagents/agent-1.jsonl").write_text("{}\n")
    (tmp_path / "a/.hid.jsonl").write_text("{}\n")
    (tmp_path / "a/no.txt").write_text("{}\n")
    got = L.read_lines(spark, str(tmp_path), "s").orderBy("raw").collect()
    assert [(r["line_no"], r["raw"]) for r in got] == [(0, '{"a":1}'), (2, '{"b":2}'), (0, "{}")]
    assert L.read_lines(spark, str(tmp_path / "none"), "s").count() == 0
    assert [r["path"].rsplit("/", 1)[1] for r in L.list_files(spark, str(tmp_path)).where(L.subagent_file()).collect()] == ["agent-1.jsonl"]
    ps = L.read_processes(spark.createDataFrame([("  12 100 1.5 /a b/c",), ("x 1 2 /y",), ("13 - 0.0 /z",)], "value string")).collect()
    assert [tuple(r) for r in ps] == [(12, 102_400, 1.5, "/a b/c"), (13, None, 0.0, "/z")]
    (tmp_path / "reg").mkdir()
    (tmp_path / "reg/12.json").write_text('{"pid": 12, "sessionId": "s", "kind": "k"}')
    (tmp_path / "reg/14.json").write_text('{"pid": 13, "sessionId": "t"}')
    assert [r["session"] for r in tasks.live_registered(spark.createDataFrame([(12,), (13,)], "pid long"), L.read_registry(spark, str(tmp_path / "reg"))).collect()] == ["s"]
    assert L.check_roots({"My Logs": "/a/b/", "x": "/c"}) == {"my-logs": "/a/b", "x": "/c"}
    for bad in ({"codex": "/a"}, {"a": "rel"}, {"a": "/x", "b": "/x/y"}):
        with pytest.raises(ValueError):
            L.check_roots(bad)


def test_api_usage(spark, tmp_path):
    key = hashlib.sha256(b"k").hexdigest()
    detail = {"timestamp": "2026-01-01T00:00:00Z", "api_key_hash": key, "tokens": {"input_tokens": 100, "output_tokens": 30, "reasoning_tokens": 5, "cached_tokens": 60, "cache_read_tokens": 20, "cache_creation_tokens": 50, "total_tokens": 130}}
    zero, other = {**detail, "tokens": {}}, {**detail, "api_key_hash": "x"}
    (tmp_path / "a.json").write_text(json.dumps({"apis": {"/v1": {"models": {"m": {"details": [detail, detail, zero, other]}}}}}))
    got = L.read_api_usage(spark, str(tmp_path / "a.json"), "k").collect()
    assert [(r["input"], r["cached_input"], r["cache_creation"], r["output"], r["reasoning"], r["total"], r["model"]) for r in got] == [(0, 60, 40, 25, 5, 130, "m")]


def test_store_replaces_files_atomically(spark, tmp_path):
    store = RawStore(spark, str(tmp_path / "s"))
    files = lambda *ids: spark.createDataFrame([(i, "s", 1, 1, 0, 9, "complete") for i in ids], "file_id string, source string, offset long, size long, mtime_ms long, parser_version int, status string")
    rows = lambda *r: spark.createDataFrame(r, "file_id string, n long")
    store.record(files("a", "b"), events=rows(("a", 1), ("a", 2), ("b", 3)))
    assert store.pending_derivation()
    store.write_derived(buckets=rows(("x", 6)))
    assert not store.pending_derivation() and store.read_derived("buckets").count() == 1
    store.record(files("a"), events=rows(("a", 10), ("stray", 1)))
    assert sorted((r["file_id"], r["n"]) for r in store.read("events").collect()) == [("a", 10), ("b", 3)]
    with pytest.raises(ValueError):
        store.read_derived("buckets")
    rows(("a", 99)).write.parquet(str(tmp_path / "s/events/generation=77"))  # a write that never got its manifest
    assert store.read("events").count() == 2
    assert store.record_network("api", raw(spark, []).drop("file_id")) is None
    for total in (5, 9):
        store.record_network("api", raw(spark, [{"input": total, "total": total}]).drop("file_id", "tier"))
    assert [r["total"] for r in store.read_network().collect()] == [9]


def test_remote_totals(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"hostname": "h", "buckets": 2, "output": 5, "more": 1}, {"buckets": 9}]')
    got = L.read_remote_totals(spark, str(tmp_path / "r.json"))
    assert [(r["hostname"], r["buckets"], r["input"]) for r in got.collect()] == [("h", 2, None)]
    assert set(usage.RECONCILED) < set(got.columns)


def test_report_lines(spark):
    local = spark.createDataFrame([("h", 1, 2)], "hostname string, buckets long, output long")
    c = usage.reconcile(local, local.withColumn("output", F.lit(3)), ["buckets", "output"])
    assert {r["field"]: r["status"] for r in c.collect()} == {"buckets": "match", "output": "mismatch"}
    said = [r["line"] for r in usage.reconcile_report(c).where("kind = 2").collect()]
    assert said == ["h: 1 fields differ"]
    assert {r["status"] for r in usage.reconcile(local, local.limit(0), ["buckets"]).collect()} == {"missing"}


def test_sums_agree(spark):
    rows = [(f"s{k % 2}", f"m{k % 3}", "p", k * 700_000, k, 1, 0, 0, 0, k + 1) for k in range(50)]
    ev = spark.createDataFrame(rows, "source string, model string, project string, ts_ms long, input long, output long, cached_input long, cache_creation long, reasoning long, total long")
    b = usage.bucket_tokens(ev).withColumn("cost", F.lit(1.0))
    assert b.agg(F.sum("total")).first()[0] == sum(r[-1] for r in rows) == usage.model_summary(b).agg(F.sum("total")).first()[0] == usage.summary(b).first()["total"]
    assert usage.summary(b.limit(0)).count() == 0


def test_sum_map(spark):
    df = spark.createDataFrame([("a", {"x": 1, "y": 2}), ("a", {"x": 5}), ("b", {})], "k string, m map<string,bigint>")
    assert {r["k"]: r["m"] for r in usage.sum_map(df, ["k"], "m").collect()} == {"a": {"x": 6, "y": 2}}


def test_lines_of_large_files_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "a.hidden-name").mkdir()
    for folder in (".git", "sub/.cache"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "x.jsonl").write_text("{}\n")
    text = [f'{{"k":{k}}}' if k % 7 else "" for k in range(3000)]
    (tmp_path / "a.hidden-name" / "long.jsonl").write_text("\n".join(text) + "\n")
    (tmp_path / "short.jsonl").write_text('{"k":0}\r\n{"k":1}')
    (tmp_path / ".dot.jsonl").write_text("{}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = L.read_lines(spark, str(tmp_path), "s")
        got = sorted((r["file_id"], r["line_no"], r["raw"]) for r in found.collect())
        assert found.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    by = {}
    for f, k, raw in got:
        by.setdefault(f, []).append((k, raw))
    assert sorted(by.values(), key=len) == [[(0, '{"k":0}'), (1, '{"k":1}')], [(k, t) for k, t in enumerate(text) if t]]


def test_a_null_model_keeps_its_bucket(spark):
    rows = [(None, 1_000_000, 0), ("big-model", 1_000_000, 0)]
    b = spark.createDataFrame(rows, "model string, input long, output long").withColumns({"cached_input": F.lit(0), "reasoning": F.lit(0)})
    p = spark.createDataFrame([(1, "big", 7.0, 1.0, 1.0, 1.0)], "rank int, pattern string, input_price double, output_price double, cache_price double, reasoning_price double")
    assert {r["model"]: r["cost"] for r in usage.with_cost(b, p).collect()} == {None: usage.FALLBACK_PRICE[0], "big-model": 7.0}


def test_rows_are_numbered_by_range(spark):
    from tallyloom.operators import incremental

    rows = spark.createDataFrame([(k * 7919 % 1000 // 2,) for k in range(1000)], "v long")
    got = [(r["row_no"], r["v"]) for r in incremental.numbered(rows, ["v"]).collect()]
    assert sorted(got) == list(enumerate(sorted(k * 7919 % 1000 // 2 for k in range(1000))))
    assert incremental.numbered(rows.limit(0), ["v"]).count() == 0


def test_highest_tier_is_taken_without_a_join(spark):
    from tallyloom.operators import dedup

    rows = spark.createDataFrame([("s", "e", 1, "f1", 9, 5), ("s", "e", 2, "f2", 3, 7), ("s", "e", 2, "f3", 4, 6)], "source string, event_id string, tier int, file_id string, input long, ts_ms long")
    out = dedup.tier_dedup(rows)
    assert [(r["tier"], r["input"], r["file_id"]) for r in out.collect()] == [(2, 4, "f3")]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()

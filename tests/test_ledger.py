"""The partitioned ledger: replacing files, dropping days, crashes after each step, reporting and old schemas."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import incremental, usage
from tallyloom.schemas import COUNTS
from tallyloom.sources import ledger as led

EVENTS = "event_id string, source string, model string, project string, ts_ms long, input long, output long, cached_input long, cache_creation long, reasoning long, total long, session_hash string, file_id string, hostname string"
FILES = "file_id string, source string, offset long, size long, mtime_ms long, parser_version int, status string"
KEYS, VALUES = ["source", "model", "project", "bucket_start_ms"], [*COUNTS, "total"]
NOW = 60 * led.DAY_MS
derive = lambda rows: usage.bucket_tokens(rows)


def event(k, file_id, day, host="", n=1):
    return (f"e{k}", "s", f"m{k % 2}", "p", day * led.DAY_MS + k * 60_000, n, 0, 0, 0, 0, n, f"h{k % 3}", file_id, host)


def files(spark, *names, status="complete"):
    return spark.createDataFrame([(f, "s", 1, 2, 3, 1, status) for f in names], FILES)


def put(spark, ledger, names, rows):
    df = spark.createDataFrame(rows, EVENTS)
    return ledger.record(files(spark, *names), events=df, session_events=df.select("event_id", "source", "session_hash", "ts_ms", "file_id"))


def ids(df):
    return sorted(r["event_id"] for r in df.collect())


def totals(df):
    return sorted(map(tuple, df.select(*KEYS, *VALUES, "revision", "synced_revision").collect()))


def test_files_are_replaced_in_their_partitions_alone(spark, tmp_path):
    ledger = led.Ledger(spark, str(tmp_path / "l"), buckets=8)
    put(spark, ledger, ["a", "b", "c"], [event(k, "abc"[k % 3], k % 4) for k in range(24)])
    first = ledger.snapshot()["tables"]["events"]
    put(spark, ledger, ["a"], [event(100, "a", 2), event(101, "a", 9)])
    second = ledger.snapshot()["tables"]["events"]
    assert ids(ledger.read("events")) == sorted([f"e{k}" for k in range(24) if k % 3] + ["e100", "e101"])
    bucket = {r[0] for r in spark.createDataFrame([("a",)], "file_id string").select(ledger._bucket()).collect()}
    assert {p for p in first if second.get(p) != first[p]} <= {p for p in first if int(p.split("/")[0]) in bucket}
    mine = ledger.read("events", ["a"])
    assert ids(mine) == ["e100", "e101"]
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in mine.inputFiles()} == bucket  # the plan reads its bucket alone
    assert {f.split("day=")[1].split("/")[0] for f in ledger.read("events", days=("1970-01-02", "1970-01-03")).inputFiles()} == {"1970-01-02", "1970-01-03"}
    put(spark, ledger, ["b"], [])  # a file without rows loses those it had
    assert not [r for r in ledger.read("events").collect() if r["file_id"] == "b"] and sorted(r["file_id"] for r in ledger.files().collect()) == ["a", "b", "c"]
    want = ids(ledger.read("events"))
    assert ledger.vacuum() > 0 and ids(ledger.read("events")) == want and ledger.vacuum() == 0
    with pytest.raises(ValueError, match="behind the end"):
        ledger.record(spark.createDataFrame([("a", "s", 9, 2, 3, 1, "complete")], FILES))
    with pytest.raises(ValueError, match="no table"):
        ledger.read("nothing")


def test_of_two_writers_the_later_one_fails(spark, tmp_path):
    a, b = (led.Ledger(spark, str(tmp_path / "l")) for _ in range(2))
    put(spark, a, ["a"], [event(1, "a", 1)])
    old = b.snapshot()
    put(spark, a, ["a"], [event(2, "a", 1)])
    with pytest.raises(led.Conflict):
        b.commit(old, frozen_ms=5)
    assert ids(b.read("events")) == ["e2"]
    broken = tmp_path / "l" / "_ledger" / "99.json"  # a writer died in the middle
    broken.write_text('{"tables": {')
    assert ids(b.read("events")) == ["e2"]
    put(spark, a, ["c"], [event(3, "c", 1)])
    assert ids(b.read("events")) == ["e2", "e3"] and b.snapshot()["n"] == 100


def test_frozen_days_are_dropped_and_crossing_sessions_stay(spark, tmp_path):
    ledger = led.Ledger(spark, str(tmp_path / "l"), buckets=4)
    rows = [event(k, "ab"[k % 2], day) for k, day in enumerate([1, 2, 28, 29, 30, 30, 31, 40, 50])]
    put(spark, ledger, ["a", "b"], rows)
    led.finalize(ledger, derive, KEYS, VALUES, "host", NOW, compact=True)
    frozen = 30 * led.DAY_MS
    snap = ledger.snapshot()
    assert snap["frozen_ms"] == frozen
    df = spark.createDataFrame(rows, EVENTS)
    want_events, want_sessions = incremental.compact_raw(df, df, frozen)
    assert ids(ledger.read("events")) == ids(want_events) and ids(ledger.read("session_events")) == ids(want_sessions)
    assert min(p.split("/")[1] for p in snap["tables"]["events"]) == "1970-01-31"
    frozen_rows = [r for r in totals(ledger.derived()) if r[3] < frozen]
    put(spark, ledger, ["a"], [event(70, "a", 5), event(72, "a", 45)])  # too late, and in time
    led.finalize(ledger, derive, KEYS, VALUES, "host", NOW, compact=True)
    assert "e70" not in ids(ledger.read("events")) and [r for r in totals(ledger.derived()) if r[3] < frozen] == frozen_rows
    put(spark, ledger, ["z"], [event(80, "z", 1)])
    ledger.record(files(spark, "z", status="degraded"))
    before = ledger.snapshot()["frozen_ms"]
    led.finalize(ledger, derive, KEYS, VALUES, "host", NOW + 5 * led.DAY_MS, compact=True)
    assert ledger.snapshot()["frozen_ms"] == before  # a degraded file holds the line


class Crash(Exception):
    pass


def test_finalize_goes_on_after_a_crash_behind_each_step(spark, tmp_path):
    rng = random.Random(1)
    first = [event(k, "ab"[k % 2], rng.choice([1, 29, 45]), n=rng.randrange(9)) for k in range(30)]
    second = [event(k, "a", rng.choice([29, 45, 50]), n=rng.randrange(9)) for k in range(40, 60)]

    def run(name, crash):
        ledger = led.Ledger(spark, str(tmp_path / name), buckets=4)
        for names, rows in ((["a", "b"], first), (["a"], second)):
            put(spark, ledger, names, rows)
            seen = []

            def after(step):
                seen.append(step)
                if step == crash and rows is second and seen.count(step) == 1:
                    raise Crash

            try:
                led.finalize(ledger, derive, KEYS, VALUES, "host", NOW, compact=True, after=after)
            except Crash:
                with pytest.raises(ValueError):
                    ledger.derived()
                written = ledger.snapshot()["derived"]
                led.finalize(ledger, derive, KEYS, VALUES, "host", NOW, compact=True, after=after)
                assert crash == "claim" or ledger.snapshot()["derived"] == written  # what was done isn't done again
        ledger.vacuum()
        return totals(ledger.derived()), ids(ledger.read("events")), ids(ledger.read("session_events")), {r["hostname"] for r in ledger.read("events").collect()}

    wanted = run("none", None)
    assert wanted[3] == {"host"} and {r[-2] for r in wanted[0]} == {1, 2}
    for step in ("claim", "recompute", "clear", "freeze", "compact"):
        assert run(step, step) == wanted, step


def test_rows_of_other_hosts_aren_t_claimed(spark, tmp_path):
    ledger = led.Ledger(spark, str(tmp_path / "l"))
    put(spark, ledger, ["a"], [event(1, "a", 45), event(2, "a", 45, "other")])
    led.finalize(ledger, derive, KEYS, VALUES, "host", NOW)
    assert {r["hostname"] for r in ledger.read("events").collect()} == {"", "other"}
    again = ledger.snapshot()["derived"]
    led.finalize(ledger, derive, KEYS, VALUES, "host", NOW)
    assert ledger.snapshot()["derived"] == again  # nothing changed: no revision, no new rows


def test_reporting_acknowledges_what_was_confirmed_exactly(spark, tmp_path):
    ledger = led.Ledger(spark, str(tmp_path / "l"))
    put(spark, ledger, ["a"], [event(k * 30, "a", 45) for k in range(57)])
    led.finalize(ledger, derive, KEYS, VALUES, "host", NOW)
    got = []

    def taking(n, last):
        calls = []

        def send(rows):
            calls.append(len(rows))
            if len(calls) == n:
                return last(rows)
            got.extend(rows)
            return len(rows)

        return send

    def fail(rows):
        raise ConnectionError("gone")

    order = ["bucket_start_ms", "source", "model", "project"]
    assert led.report(ledger, taking(1, lambda rows: len(rows) - 1), order, "host", most=10, chunk=2) == {"attempted": 10, "acknowledged": 0, "pending": 57, "failed": "9 of 10 rows were confirmed"}
    assert led.report(ledger, taking(4, fail), order, "host", most=10, chunk=2) == {"attempted": 40, "acknowledged": 30, "pending": 27, "failed": "gone"}
    put(spark, ledger, ["a"], [event(k * 30, "a", 45, n=2 if k == 3 else 1) for k in range(57)])  # a row that was sent changes
    led.finalize(ledger, derive, KEYS, VALUES, "host", NOW)
    assert led.report(ledger, taking(0, None), order, "host", most=10)["acknowledged"] == 28
    assert led.report(ledger, taking(0, None), order, "host", most=10) == {"attempted": 0, "acknowledged": 0, "pending": 0, "failed": None}
    assert len(got) == 58 and len({(*(r[c] for c in order), r["revision"]) for r in got}) == 58
    assert [r["bucket_start_ms"] for r in got[:30]] == sorted(r["bucket_start_ms"] for r in got[:30])
    with pytest.raises(ValueError, match="another host"):
        led.report(ledger, taking(0, None), order, "elsewhere")


def test_a_crash_between_pages_sends_no_page_twice(spark, tmp_path):
    ledger, seen = led.Ledger(spark, str(tmp_path / "l")), []
    put(spark, ledger, ["a"], [event(k * 30, "a", 45) for k in range(25)])
    led.finalize(ledger, derive, KEYS, VALUES, "host", NOW)

    def send(rows):
        if len(seen) == 20:
            raise KeyboardInterrupt  # not an answer of the receiver: the process dies
        seen.extend(r["bucket_start_ms"] for r in rows)
        return len(rows)

    with pytest.raises(KeyboardInterrupt):
        led.report(ledger, send, KEYS, "host", most=10)
    done = led.report(ledger, lambda rows: seen.extend(r["bucket_start_ms"] for r in rows) or len(rows), KEYS, "host", most=10)
    assert done["acknowledged"] == 25 and len(seen) == len(set(seen)) == 25


def test_the_outbox_is_sorted_once_and_pages_are_pruned(spark, tmp_path):
    ledger = led.Ledger(spark, str(tmp_path / "l"))
    put(spark, ledger, ["a"], [event(k * 30, "a", 45) for k in range(40)])
    led.finalize(ledger, derive, KEYS, VALUES, "host", NOW)
    box = led._outbox(ledger, ledger.snapshot(), KEYS, 7)
    assert box["pages"] == 6
    rows = ledger.read_version("outbox", box["version"])
    plan = rows.where("page >= 2 and page < 3")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(page,2)" in plan and "Sort" not in plan and "Exchange" not in plan
    assert sorted(r["n"] for r in rows.groupBy("page").agg(F.count("*").alias("n")).collect()) == [5, 7, 7, 7, 7, 7]


def test_stores_of_each_older_schema_are_read_as_the_newest(spark, tmp_path):
    ups = {
        1: lambda rows: rows.withColumn("ts_ms", F.col("ts_s") * 1000).drop("ts_s"),
        2: lambda rows: rows.withColumn("hostname", F.lit("")),
        3: lambda rows: rows.withColumn("reasoning", F.coalesce("reasoning", F.lit(0).cast("long"))),
    }

    def code(version):
        """The migrations that the code of that version had."""
        steps = led.Migrations()
        for v in range(1, version):
            steps.step("events", v)(ups[v])
        return steps

    rows = [event(k, "abcd"[k % 4], 45) for k in range(8)]
    df = spark.createDataFrame(rows, EVENTS)
    wanted = sorted(map(str, df.select(sorted(df.columns)).collect()))
    # ts_ms is what partitions are made by, so also the oldest rows have it on writing
    old = {1: df.withColumn("ts_s", (F.col("ts_ms") / 1000).cast("long")).drop("hostname"), 2: df.drop("hostname"), 3: df.withColumn("reasoning", F.lit(None).cast("long")), 4: df}
    for first in (1, 2, 3, 4):
        ledger = led.Ledger(spark, str(tmp_path / f"v{first}"), buckets=64)
        for version, file_id in zip([*range(first, 5), 4, 4, 4], "abcd"):  # a store that has lived through the versions
            ledger.migrations = code(version)
            ledger.record(files(spark, file_id), events=old[version].where(F.col("file_id") == file_id))
        assert {e["schema"] for e in ledger.snapshot()["tables"]["events"].values()} == set(range(first, 5))
        out = ledger.read("events")
        assert sorted(map(str, out.select(sorted(df.columns)).collect())) == wanted, first
        ledger.record(files(spark, "a"), events=df.where("file_id = 'a'"))  # what is written again is of the newest
        assert sorted(map(str, ledger.read("events").select(sorted(df.columns)).collect())) == wanted
        assert {e["schema"] for e in ledger.snapshot()["tables"]["events"].values()} == {4} | set(range(first + 1, 5))
    ledger.migrations = led.Migrations(3)
    with pytest.raises(ValueError, match="knows 3"):
        ledger.read("events")
    with pytest.raises(ValueError, match="two steps"):
        code(3).step("events", 2)(lambda r: r)

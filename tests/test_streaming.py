"""Streams against their batch meaning; few, because each start costs seconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.streaming import live


def run(query, name):
    q = query.trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def write(spark, rows, schema, path, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_counter_state_spans_batches(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    s = 1_000_000
    stream = lambda: live.counter_intervals(spark.readStream.schema(live.COUNTER_ROWS).parquet(src))
    write(spark, [("f", 1, 10 * s, 100, "m", None), ("f", 2, 20 * s, 160, None, None), ("sub", 1, 1 * s, 500, "x", 0), ("sub", 2, 3 * s, 510, "x", 0)], live.COUNTER_ROWS, src, 1)
    run(stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append"), "a")
    write(spark, [("f", 3, 30 * s, 280, "n", None), ("f", 4, 40 * s, 5, None, None), ("f", 5, 50 * s, 9, None, None), ("f", 6, 900 * s, 99, None, None)], live.COUNTER_ROWS, src, 2)
    run(stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append"), "b")
    got = sorted((r["file_id"], r["start_us"] // s, r["end_us"] // s, r["tokens"], r["model"]) for r in spark.read.parquet(out).collect())
    assert got == [("f", 10, 20, 60, "m"), ("f", 20, 30, 120, "n"), ("f", 40, 50, 4, "n"), ("sub", 1, 3, 10, "x")]


def test_messages_grow_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "file_id string, line_no long, message string, model string, tokens long, at_ms long"
    stream = lambda: live.message_growth(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append")
    write(spark, [("f", 1, "a", "m", 5, 0), ("f", 2, "a", "m", 9, 1), ("f", 3, None, "m", 4, 1), ("f", 4, None, "m", 4, 2)], schema, src, 1)
    run(stream(), "a")
    write(spark, [("f", 5, "a", "m", 9, 3), ("f", 6, "a", "m", 12, 4), ("f", 7, None, "m", 4, 5)], schema, src, 2)
    run(stream(), "b")
    assert sorted(r["tokens"] for r in spark.read.parquet(out).collect()) == [3, 4, 4, 4, 5]


def test_buckets_drop_late_rows_and_samples_are_written(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "ts timestamp, source string, model string, project string, input long, output long, cached_input long, cache_creation long, reasoning long, total long"
    rows = lambda *ms: spark.createDataFrame([(m, "s", "m", "p", 1, 1, 0, 0, 0, 2) for m in ms], "ms long, " + schema.split(", ", 1)[1]).select(F.timestamp_millis("ms").alias("ts"), *[c.split()[0] for c in schema.split(", ")[1:]])
    h = 3_600_000
    for k, batch in enumerate([(0, 60_000), (3 * h,), (120_000,), (6 * h,)]):
        rows(*batch).coalesce(1).write.mode("append").parquet(src)
    stream = live.bucket_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    run(stream.writeStream.format("memory").queryName("buckets").outputMode("append"), "x")
    got = {r["bucket_start_ms"]: r["total"] for r in spark.table("buckets").collect()}
    assert got.get(0) in (2, 4, 6) and got.get(3 * h, 2) == 2
    iv, out = str(tmp_path / "iv"), str(tmp_path / "live")
    write(spark, [("f", 0, 0, 180, "m")], live.INTERVALS, iv, 1)
    run(live.write_samples(spark.readStream.schema(live.INTERVALS).parquet(iv), out, str(tmp_path / "cp2")), "y")
    s = spark.read.parquet(f"{out}/samples").collect()
    assert [(r["state"], r["tps"]) for r in s] == [("live", 1.0)]
    many = spark.range(30).select((F.col("id") * 1_000_000).alias("tick_us"))
    assert live.retained(many, 10).agg(F.min("tick_us")).first()[0] == 20_000_000

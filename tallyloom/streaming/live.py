"""Structured Streaming over the batch operators: bucket sums, counters with state, live samples."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.functions.exprs import saturating_sum
from tallyloom.operators import rate
from tallyloom.operators.incremental import keep_newest
from tallyloom.schemas import COUNTS, WINDOW_SECONDS

RETAINED = 21_600
INHERITED_PREFIX_US = 2_000_000
MESSAGE_TTL_MS = 600_000
MOST_MESSAGES = 2048


def read_chunks(spark: SparkSession, root: str, most_files: int = 96) -> DataFrame:
    """Lines of files as they land. A file is read once; growing files land as one new file per append."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", most_files).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(root)
    return lines.where(F.trim("value") != "")


def bucket_stream(events: DataFrame, late: str = "180 seconds") -> DataFrame:
    """Half-hour token sums per source, model and project; rows later than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "30 minutes"), "source", "model", "project")
    return w.agg(*[saturating_sum(c).alias(c) for c in [*COUNTS, "total"]]).select(F.unix_millis("window.start").alias("bucket_start_ms"), "source", "model", "project", *COUNTS, "total")


COUNTER_ROWS = "file_id string, line_no long, at_us long, total long, model string, meta_us long"
INTERVALS = "file_id string, start_us long, end_us long, tokens long, model string"


def counter_intervals(rows: DataFrame) -> DataFrame:
    """Growth of each file's cumulative counter as intervals, across batches.

    The first total of a file is a baseline, and so is one after a fall or more than 180 s later; history is never played back. Totals of a
    sub-agent file within 2 s of its start are its parent's. A row without a model takes the next one known in its batch, or the last.
    """

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        total, at, model = state.get if state.exists else (None, None, None)
        got = pd.concat(list(batches)).sort_values("line_no")
        named = got["model"].dropna()
        model = model or (named.iloc[0] if len(named) else None)
        out = []
        for r in got.itertuples(index=False):
            model = r.model if isinstance(r.model, str) else model
            if pd.isna(r.total):
                continue
            inherited = not pd.isna(r.meta_us) and r.at_us - r.meta_us < INHERITED_PREFIX_US
            if total is not None and not inherited and total < r.total and 0 <= r.at_us - at <= WINDOW_SECONDS * rate.US:
                out.append((key[0], int(at), int(r.at_us), int(r.total - total), model or "unknown"))
            total, at = int(r.total), int(r.at_us)
        state.update((total, at, model))
        yield pd.DataFrame(out, columns=["file_id", "start_us", "end_us", "tokens", "model"])

    return rows.groupBy("file_id").applyInPandasWithState(step, INTERVALS, "total long, at long, model string", "append", GroupStateTimeout.NoTimeout)


def message_growth(rows: DataFrame) -> DataFrame:
    """``(file_id, message, tokens)``: what a message's usage grew by over the most seen so far. A message is forgotten ten minutes after its last row; at most 2048 of a file are kept.

    Rows without an id count once per batch for each model and size.
    """

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import json

        import pandas as pd

        seen: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
        got, out, loose = pd.concat(list(batches)).sort_values("line_no"), [], set()
        for r in got.itertuples(index=False):
            if not isinstance(r.message, str):
                if (r.model, r.tokens) not in loose and r.tokens > 0:
                    out.append((key[0], None, int(r.tokens)))
                loose.add((r.model, r.tokens))
                continue
            most = seen.get(r.message, [0, 0])[0]
            if r.tokens > most:
                out.append((key[0], r.message, int(r.tokens - most)))
            seen[r.message] = [int(max(most, r.tokens)), int(r.at_ms)]
        newest = max((t for _, t in seen.values()), default=0)
        kept = sorted(((t, m) for m, (_, t) in seen.items() if newest - t <= MESSAGE_TTL_MS), reverse=True)[:MOST_MESSAGES]
        state.update((json.dumps({m: seen[m] for _, m in kept}),))
        yield pd.DataFrame(out, columns=["file_id", "message", "tokens"])

    return rows.groupBy("file_id").applyInPandasWithState(step, "file_id string, message string, tokens long", "seen string", "append", GroupStateTimeout.NoTimeout)


def write_samples(intervals: DataFrame, path: str, checkpoint: str, ticks_per_batch: int = 1):
    """Starts a query that appends each batch's intervals and writes the samples of its newest seconds; retention keeps six hours of them.

    Intervals are laid out by hour and a batch reads the newest hours alone. A sample for every second, also while nothing arrives, is ``stateful.second_samples``.
    """
    spark = intervals.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max("end_us")).first()[0]
        if newest is None:
            return
        hour = lambda us: F.floor(us / (3600 * rate.US))
        batch.withColumn("hour", hour(F.col("end_us"))).write.mode("overwrite").partitionBy("hour").parquet(f"{path}/intervals/batch={number}")
        since = newest - 2 * WINDOW_SECONDS * rate.US
        recent = spark.read.parquet(f"{path}/intervals").where((F.col("hour") >= hour(F.lit(since))) & (F.col("end_us") >= since)).withColumn("interval_id", F.monotonically_increasing_id())
        top = -(-newest // rate.US) * rate.US
        ticks = spark.range(ticks_per_batch).select((F.lit(top) - F.col("id") * rate.US).alias("tick_us"))
        samples = rate.live_samples(ticks, recent, recent.select(F.col("end_us").alias("signal_us")))
        samples.write.mode("overwrite").parquet(f"{path}/samples/batch={number}")

    return intervals.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).outputMode("append")


def retained(samples: DataFrame, most: int = RETAINED) -> DataFrame:
    """Samples of the last six hours before the newest, at most one a second."""
    last = samples.agg(F.max("tick_us").alias("last"))
    recent = samples.crossJoin(F.broadcast(last)).where(F.col("tick_us") >= F.col("last") - RETAINED * rate.US).drop("last")
    return keep_newest(recent.withColumn("id", F.col("tick_us")), most, "tick_us").drop("id")

"""Curves on a grid: resampling, gaps, smoothing, normalising, trends.

A series is ``(idx, value)`` with null gaps, per ``keys``. Series are at most some thousand points long (3600 s at 1 s),
so a window per series is small; there may be any number of series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Span and step in seconds, smoothing radius.
SPANS = {"15m": (900, 5, 0), "1h": (3600, 5, 1), "24h": (86_400, 1800, 0)}
FALL, FLOOR, BOUND, CLIP = -0.30, 0.5, 1.0, 0.10


def _w(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("idx") if keys else Window.partitionBy(F.lit(0)).orderBy("idx")


def numeric_value(state: str = "state", tps: str = "tps") -> Column:
    """The rate of live and zero samples; other states are gaps."""
    return F.when(F.col(state).isin("live", "zero") & (F.col(tps) >= 0), F.col(tps))


def short_value(state: str = "state", tokens_5: str = "tokens_5", tps: str = "tps") -> Column:
    return F.when(F.col(state).isin("live", "zero"), F.coalesce(F.col(tokens_5) / 5, F.col(tps)))


def second_value(state: str = "state", tokens_1: str = "tokens_1") -> Column:
    return F.when(F.col(state).isin("live", "zero") & F.col(tokens_1).isNotNull(), F.col(tokens_1).cast("double"))


def grid(points: int, keys: DataFrame | None = None) -> DataFrame:
    g = (keys.sparkSession if keys is not None else _spark()).range(points).select(F.col("id").alias("idx"))
    return g if keys is None else keys.crossJoin(F.broadcast(g))


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def resample(points: DataFrame, end_us: Column | int, window_s: int, step_s: int) -> DataFrame:
    """``(idx, at_us, value)`` for window / step + 1 cells that end at ``end_us``: in each the valid value nearest to its centre, the earliest of two."""
    end = F.lit(end_us) if isinstance(end_us, int) else end_us
    step = step_s * 1_000_000
    start = end - window_s * 1_000_000
    p = points.where(F.col("value").isNotNull()).withColumn("end", end).withColumn("off", F.col("at_us") - start).where((F.col("off") >= 0) & (F.col("at_us") <= F.col("end")))
    p = p.withColumn("idx", F.round(F.col("off") / step).cast("long"))
    best = p.groupBy("idx").agg(F.min_by("value", F.struct(F.abs(F.col("off") - F.col("idx") * step), "at_us")).alias("value"))
    cells = points.sparkSession.range(round(window_s / step_s) + 1).select(F.col("id").alias("idx"))
    return cells.join(best, "idx", "left")


def bucketed_mean(points: DataFrame, end_us: Column | int, total_s: int, bucket_s: int) -> DataFrame:
    """``(idx, value)`` for total / bucket cells that end at ``end_us``: sum over the width of a cell; null where a cell has no value."""
    end = F.lit(end_us) if isinstance(end_us, int) else end_us
    width, n = bucket_s * 1_000_000, total_s // bucket_s
    p = points.where(F.col("value").isNotNull()).withColumn("idx", F.floor((F.col("at_us") - (end - total_s * 1_000_000)) / width))
    sums = p.where(F.col("idx").between(0, n - 1)).groupBy("idx").agg((F.sum("value") / bucket_s).alias("value"))
    return points.sparkSession.range(n).select(F.col("id").alias("idx")).join(sums, "idx", "left")


def interpolate(series: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Gaps between two values are filled on the line, gaps at the ends with the nearest value; a series without a value stays."""
    back = _w(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = _w(keys).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    at = F.when(F.col("value").isNotNull(), F.struct("idx", "value"))
    s = series.withColumn("l", F.last(at, ignorenulls=True).over(back)).withColumn("r", F.first(at, ignorenulls=True).over(ahead))
    share = (F.col("idx") - F.col("l.idx")) / (F.col("r.idx") - F.col("l.idx"))
    line = F.col("l.value") + (F.col("r.value") - F.col("l.value")) * share
    return s.withColumn("value", F.coalesce("value", F.when(F.col("l").isNull(), F.col("r.value")).when(F.col("r").isNull(), F.col("l.value")).otherwise(line))).drop("l", "r")


def segments(series: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``seg``: number of the run of values without a gap; gaps belong to the run before them."""
    return series.withColumn("seg", F.sum(F.col("value").isNull().cast("int")).over(_w(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def smoothing_weights(radius: int) -> list[float]:
    """Weights for offsets 0 to r of a gaussian whose window is clamped to 3..13 points."""
    r = min(max(2 * max(0, radius) + 1, 3), 13) // 2
    sigma = max(0.5, r / 2)
    return [math.exp(-(x * x) / (2 * sigma * sigma)) for x in range(r + 1)]


def gaussian(series: DataFrame, radius: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Weighted mean within each run; at its edges the weights that are left are renormalised."""
    weights = smoothing_weights(radius)
    s = segments(series, keys)
    w = Window.partitionBy(*keys, "seg").orderBy("idx")
    acc = norm = None
    for x in range(-len(weights) + 1, len(weights)):
        v = F.col("value") if x == 0 else F.lag("value", -x).over(w)
        k = weights[abs(x)]
        acc = F.coalesce(v * k, F.lit(0.0)) if acc is None else acc + F.coalesce(v * k, F.lit(0.0))
        norm = F.when(v.isNotNull(), k).otherwise(0.0) if norm is None else norm + F.when(v.isNotNull(), k).otherwise(0.0)
    return s.withColumn("value", F.when(F.col("value").isNotNull(), acc / norm)).drop("seg")


def ema(series: DataFrame, alpha: float, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Exponential moving average within each run, seeded with its first value; each run takes one pass in its order."""
    s = segments(series.where("value is not null").unionByName(series.where("value is null")), keys)
    kept = s.where("value is not null").select(*keys, "seg", "idx", F.col("value").cast("double").alias("value"))

    def follow(run):
        run = run.sort_values("idx")
        return run.assign(value=run["value"].ewm(alpha=alpha, adjust=False).mean())

    out = kept.groupBy(*keys, "seg").applyInPandas(follow, kept.schema).select(*keys, "idx", "value")
    return series.drop("value").join(out, [*keys, "idx"], "left")


def quantile(column: str, q: float) -> Column:
    """Exact, linearly interpolated."""
    return F.percentile(column, q)


def normalise(series: DataFrame, keys: list[str] = [], clip: float = CLIP) -> DataFrame:  # noqa: B006
    """``normalized``: 0..1 between the clipped quantiles; 0.5 in a flat series; null in gaps."""
    bounds = series.groupBy(*keys).agg(quantile("value", clip).alias("lo"), quantile("value", 1 - clip).alias("hi"))
    s = series.join(F.broadcast(bounds), keys) if keys else series.crossJoin(F.broadcast(bounds))
    span = F.col("hi") - F.col("lo")
    norm = F.when(F.col("value").isNull(), None).when(span <= 0, 0.5).otherwise(F.least(F.greatest((F.col("value") - F.col("lo")) / span, F.lit(0.0)), F.lit(1.0)))
    return s.withColumn("normalized", norm).drop("lo", "hi")


def regression(series: DataFrame, keys: list[str] = [], x: str = "x") -> DataFrame:  # noqa: B006
    """Least-squares slope, its relative size over the span (clamped to 1), points and trend. Any growth rises; only a fall beyond 30 % falls."""
    found = series.groupBy(*keys).agg(
        F.count("value").alias("n"), F.regr_slope("value", F.when(F.col("value").isNotNull(), F.col(x))).alias("slope"), F.avg("value").alias("mean"),
        (F.max(F.when(F.col("value").isNotNull(), F.col(x))) - F.min(F.when(F.col("value").isNotNull(), F.col(x)))).alias("span"),
    )
    slope = F.when(F.col("n") >= 2, F.coalesce("slope", F.lit(0.0)))
    rel = F.least(F.greatest(slope * F.col("span") / F.greatest(F.abs("mean"), F.lit(FLOOR)), F.lit(-BOUND)), F.lit(BOUND))
    trend = F.when(F.col("n") < 2, "insufficient").when(rel > 0, "rising").when(rel < FALL, "falling").otherwise("flat")
    return found.select(*keys, "n", slope.alias("slope"), rel.alias("normalized_slope"), trend.alias("trend"))


def statistics(series: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Latest, peak and mean of the values; no row for a series without one."""
    latest = F.max_by("value", F.when(F.col("value").isNotNull(), F.col("idx")))
    return series.groupBy(*keys).agg(F.count("value").alias("n"), latest.alias("latest"), F.max("value").alias("peak"), F.avg("value").alias("mean")).where("n > 0")


def chart_bounds(series: DataFrame) -> DataFrame:
    """Value axis: padded by 8 % of the range, 0.5 at least, never below zero; 0 to 1 where there is nothing."""
    b = series.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    pad = F.greatest((F.col("hi") - F.col("lo")) * 0.08, F.lit(0.5))
    return b.select(F.when(F.col("lo").isNull(), 0.0).otherwise(F.greatest(F.col("lo") - pad, F.lit(0.0))).alias("low"), F.when(F.col("hi").isNull(), 1.0).otherwise(F.col("hi") + pad).alias("high"))


def visible_models(series: DataFrame) -> DataFrame:
    """Models with a positive point and their latest value."""
    latest = F.max_by("value", F.when(F.col("value").isNotNull(), F.col("idx")))
    return series.groupBy("model").agg(F.max("value").alias("peak"), latest.alias("latest")).where("peak > 0")


def sparkline(points: DataFrame, end_us: Column | int, window_s: int = 900, step_s: int = 1, radius: int = 2) -> DataFrame:
    """Resampled, filled for drawing, smoothed and normalised; ``raw`` keeps the gaps."""
    raw = resample(points, end_us, window_s, step_s)
    drawn = normalise(gaussian(interpolate(raw), radius))
    return raw.withColumnRenamed("value", "raw").join(drawn.select("idx", "value", "normalized"), "idx")


def bucketed_sparkline(points: DataFrame, end_us: Column | int, span: str) -> DataFrame:
    total, bucket, radius = SPANS[span]
    raw = bucketed_mean(points, end_us, total, bucket)
    smooth = gaussian(raw, radius) if radius else raw
    return normalise(interpolate(smooth)).withColumnRenamed("value", "drawn").join(raw, "idx")


def day_grid(buckets: DataFrame, end_us: Column | int) -> DataFrame:
    """48 half-hour cells up to the next half hour: output tokens of the cell over 1800 s."""
    end = F.lit(end_us) if isinstance(end_us, int) else end_us
    top = F.ceil(end / 1_800_000_000) * 1_800_000_000
    idx = F.floor((F.col("bucket_start_ms") * 1000 - (top - 86_400_000_000)) / 1_800_000_000)
    sums = buckets.withColumn("idx", idx).where(F.col("idx").between(0, 47)).groupBy("idx").agg((F.sum("output") / 1800).alias("value"))
    return buckets.sparkSession.range(48).select(F.col("id").alias("idx")).join(sums, "idx", "left")


def model_list(samples: DataFrame, at: str = "at", state: str = "state", by_model: str = "by_model") -> DataFrame:
    """``(model, value, place)``: every model of the live and zero samples with its value in the last one, else zero; largest first, then by name."""
    valid = samples.where(F.col(state).isin("live", "zero"))
    names = valid.select(F.explode(F.map_keys(by_model)).alias("model")).distinct()
    last = valid.agg(F.max_by(by_model, at).alias("last")).select(F.explode("last").alias("model", "value"))
    found = names.join(last, "model", "left").select("model", F.coalesce("value", F.lit(0.0)).alias("value"))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "model")).cast("long"))  # a row per model

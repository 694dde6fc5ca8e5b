"""Rates and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import curves, rate, tasks
from tallyloom.plans.catalogue import query
from tallyloom.plans.tables import USAGE
from tallyloom.plans.tables import usage as usage_rows

# -- rates: every event is a tick and ends an interval of k seconds ------------------------------

RATE = f"{USAGE}, ticks AS (SELECT DISTINCT ts_us AS tick_us FROM usage), iv AS (SELECT n AS interval_id, ts_us-k*1000000 AS start_us, ts_us AS end_us, input AS tokens, model FROM usage WHERE input>0)"


def ticks(spark, d) -> DataFrame:
    return usage_rows(spark, d).select(F.col("ts_us").alias("tick_us")).distinct()


def intervals(spark, d) -> DataFrame:
    u = usage_rows(spark, d)
    return rate.valid_intervals(u.select(F.col("n").alias("interval_id"), (F.col("ts_us") - F.col("k") * 1_000_000).alias("start_us"), F.col("ts_us").alias("end_us"), F.col("input").alias("tokens"), "model"))


def _overlap_sql(seconds: int, slack: int, keys: str, rounded: bool = True, more: str = "") -> str:
    part = f"tokens*least(1.0,(least(end_us,tick_us+{slack}000000)-greatest(start_us,tick_us-{seconds}000000))/CAST(end_us-start_us AS DOUBLE))"
    part = f"CASE WHEN end_us<=start_us THEN CAST(tokens AS DOUBLE) ELSE {f'round({part})' if rounded else part} END"
    return f"p AS (SELECT tick_us, interval_id, model, {part} AS part FROM ticks JOIN iv ON start_us<=tick_us+{slack}000000 AND end_us>=tick_us-{seconds}000000 {more}) SELECT {keys}, {'' if rounded else 'round('}sum(part){'' if rounded else ',6)'} AS tokens FROM p WHERE part>0 GROUP BY {keys}"


@query("a15_window_180s", f"WITH {RATE}, {_overlap_sql(180, 5, 'tick_us')}")
def a15(spark, d):
    return rate.tokens_in_window(ticks(spark, d), intervals(spark, d))


@query("a15_window_180s_by_model", f"WITH {RATE}, {_overlap_sql(180, 5, 'tick_us, model')}")
def a15m(spark, d):
    return rate.tokens_in_window(ticks(spark, d), intervals(spark, d), by_model=True)


@query("a16_window_5s", f"WITH {RATE}, {_overlap_sql(5, 5, 'tick_us')}")
def a16(spark, d):
    return rate.tokens_in_short_window(ticks(spark, d), intervals(spark, d))


@query("a17_last_second", f"WITH {RATE}, {_overlap_sql(1, 0, 'tick_us', False, 'AND (end_us>start_us OR end_us>tick_us-1000000)')}")
def a17(spark, d):
    out = rate.tokens_in_last_second(ticks(spark, d), intervals(spark, d))
    return out.withColumn("tokens", F.round("tokens", 6))


@query("j10_overlap_pairs", f"WITH {RATE} SELECT tick_us, interval_id FROM ticks JOIN iv ON start_us<=tick_us+5000000 AND end_us>=tick_us-180000000")
def j10(spark, d):
    return rate.overlaps(ticks(spark, d), intervals(spark, d), 180).select("tick_us", "interval_id")


_W = _overlap_sql(180, 5, "tick_us")
_STATE = f"""{RATE}, w AS (WITH {_W}), s AS (SELECT tick_us, sig.at AS latest_us FROM ticks ASOF LEFT JOIN (SELECT DISTINCT ts_us-400000000*(n%2) AS at FROM usage) sig ON ticks.tick_us>=sig.at),
 st AS (SELECT s.tick_us, latest_us, coalesce(tokens,0) AS tokens_180, CASE WHEN latest_us IS NULL THEN 'no_data' WHEN s.tick_us-latest_us>300000000 THEN 'stale' WHEN coalesce(tokens,0)>0 THEN 'live' ELSE 'zero' END AS state FROM s LEFT JOIN w ON s.tick_us=w.tick_us)"""


@query("t15_rate_state", f"WITH {_STATE} SELECT tick_us, state, CASE WHEN state IN ('live','zero') THEN round(tokens_180/180,6) END AS tps FROM st")
def t15(spark, d):
    signals = usage_rows(spark, d).select((F.col("ts_us") - 400_000_000 * (F.col("n") % 2)).alias("signal_us"))
    out = rate.live_samples(ticks(spark, d), intervals(spark, d), signals)
    return out.select("tick_us", "state", F.round("tps", 6).alias("tps"))


@query("a18_current_rate", f"WITH {RATE}, w AS (WITH {_W}) SELECT tick_us, round(tokens/180,6) AS tps FROM w")
def a18(spark, d):
    w = rate.tokens_in_window(ticks(spark, d), intervals(spark, d))
    return w.select("tick_us", F.round(rate.current_rate("tokens"), 6).alias("tps"))


@query("p29_sample_constraints", f"WITH {USAGE} SELECT n, CASE k%5 WHEN 0 THEN 'live' WHEN 1 THEN 'zero' WHEN 2 THEN 'stale' WHEN 3 THEN 'no_data' ELSE 'unavailable' END AS state, CASE k%5 WHEN 0 THEN CAST(input AS DOUBLE) WHEN 1 THEN 0.0 END AS tps FROM usage")
def p29(spark, d):
    k = F.col("k") % 5
    state = F.when(k == 0, "live").when(k == 1, "zero").when(k == 2, "stale").when(k == 3, "no_data").otherwise("unavailable")
    return tasks.normalise_sample(usage_rows(spark, d).select("n", state.alias("state"), F.col("input").cast("double").alias("tps")))


@query("p28_snapshot_constraints", f"WITH {USAGE} SELECT n, CASE k%3 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'partial' ELSE 'exact' END AS quality, CASE WHEN k%3<>0 THEN CAST(greatest(k-50,0) AS DOUBLE) END AS total, k%3=1 AS lower_bound FROM usage")
def p28(spark, d):
    quality = F.when(F.col("k") % 3 == 0, "unavailable").when(F.col("k") % 3 == 1, "partial").otherwise("exact")
    out = tasks.normalise_snapshot(usage_rows(spark, d).select("n", quality.alias("quality"), (F.col("k") - 50).alias("total")))
    return out.withColumn("total", F.col("total").cast("double"))


# -- curves: hourly points with gaps, one series per model ---------------------------------------

SERIES = f"{USAGE}, g AS (SELECT m.model, i AS idx FROM (SELECT DISTINCT model FROM usage) m, range(0,720) t(i)), h AS (SELECT model, (ts_us-1704067200000000)//3600000000 AS idx, CAST(sum(input) AS DOUBLE) AS value FROM usage GROUP BY 1,2 HAVING sum(input)%5<>0), s AS (SELECT model, idx, value FROM g LEFT JOIN h USING (model, idx))"
START = 1_704_067_200_000_000


def series(spark, d) -> DataFrame:
    u = usage_rows(spark, d)
    h = u.groupBy("model", F.floor((F.col("ts_us") - START) / 3_600_000_000).alias("idx")).agg(F.sum("input").alias("v")).where("v % 5 <> 0")
    g = curves.grid(720, u.select("model").distinct())
    return g.join(h, ["model", "idx"], "left").select("model", "idx", F.col("v").cast("double").alias("value"))


@query("w12_interpolate", f"""WITH {SERIES}, b AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER p AS li, last_value(value IGNORE NULLS) OVER p AS lv,
 first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS ri, first_value(value IGNORE NULLS) OVER f AS rv FROM s
 WINDOW p AS (PARTITION BY model ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY model ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT model, idx, round(CASE WHEN value IS NOT NULL THEN value WHEN li IS NULL THEN rv WHEN ri IS NULL THEN lv ELSE lv+(rv-lv)*((idx-li)/CAST(ri-li AS DOUBLE)) END,6) AS value FROM b""")  # fmt: skip
def w12(spark, d):
    return curves.interpolate(series(spark, d), ["model"]).withColumn("value", F.round("value", 6))


SEG = f"{SERIES}, sg AS (SELECT *, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY model ORDER BY idx ROWS UNBOUNDED PRECEDING) AS seg FROM s)"


def _gauss_sql(radius: int) -> str:
    w = curves.smoothing_weights(radius)
    near = [(x, w[abs(x)], f"lag(value,{-x}) OVER w" if x < 0 else f"lead(value,{x}) OVER w" if x else "value") for x in range(-len(w) + 1, len(w))]
    acc = "+".join(f"coalesce({v}*CAST({k!r} AS DOUBLE),0)" for _, k, v in near)
    norm = "+".join(f"CASE WHEN {v} IS NOT NULL THEN CAST({k!r} AS DOUBLE) ELSE 0 END" for _, k, v in near)
    return f"WITH {SEG} SELECT model, idx, CASE WHEN value IS NOT NULL THEN round(({acc})/({norm}),5) END AS value FROM sg WINDOW w AS (PARTITION BY model, seg ORDER BY idx)"


@query("w10_gaussian_smooth", _gauss_sql(2))
def w10(spark, d):
    return curves.gaussian(series(spark, d), 2, ["model"]).withColumn("value", F.round("value", 5))


@query("w11_ema", f"""WITH RECURSIVE {SEG}, o AS (SELECT model, idx, seg, value, row_number() OVER (PARTITION BY model, seg ORDER BY idx) AS r FROM sg WHERE value IS NOT NULL),
 e AS (SELECT model, idx, seg, r, value AS v FROM o WHERE r=1 UNION ALL SELECT o.model, o.idx, o.seg, o.r, 0.3*o.value+0.7*e.v FROM e JOIN o ON o.model=e.model AND o.seg=e.seg AND o.r=e.r+1)
 SELECT s.model, s.idx, round(v,5) AS value FROM s LEFT JOIN e ON s.model=e.model AND s.idx=e.idx""")  # fmt: skip
def w11(spark, d):
    return curves.ema(series(spark, d), 0.3, ["model"]).select("model", "idx", F.round("value", 5).alias("value"))


@query("a22_quantile_clip_norm", f"WITH {SERIES}, q AS (SELECT model, quantile_cont(value,0.1) AS lo, quantile_cont(value,0.9) AS hi FROM s GROUP BY 1) SELECT model, idx, CASE WHEN value IS NULL THEN NULL WHEN hi-lo<=0 THEN 0.5 ELSE round(least(greatest((value-lo)/(hi-lo),0.0),1.0),6) END AS normalized FROM s JOIN q USING (model)")
def a22(spark, d):
    return curves.normalise(series(spark, d), ["model"]).select("model", "idx", F.round("normalized", 6).alias("normalized"))


@query("a21_trend_regression", f"""WITH {SERIES}, r AS (SELECT model, idx//240 AS part, count(value) AS n, regr_slope(value, CASE WHEN value IS NOT NULL THEN CAST(idx*3600 AS DOUBLE) END) AS slope, avg(value) AS mean, max(CASE WHEN value IS NOT NULL THEN idx*3600 END)-min(CASE WHEN value IS NOT NULL THEN idx*3600 END) AS span FROM s GROUP BY 1,2),
 x AS (SELECT *, least(greatest(slope*span/greatest(abs(mean),0.5),-1.0),1.0) AS rel FROM r) SELECT model, part, n, round(slope,6) AS slope, round(rel,6) AS normalized_slope, CASE WHEN n<2 THEN 'insufficient' WHEN rel>0 THEN 'rising' WHEN rel<-0.3 THEN 'falling' ELSE 'flat' END AS trend FROM x""")  # fmt: skip
def a21(spark, d):
    s = series(spark, d).withColumns({"part": F.floor(F.col("idx") / 240), "x": (F.col("idx") * 3600).cast("double")})
    out = curves.regression(s, ["model", "part"])
    return out.withColumns({"slope": F.round("slope", 6), "normalized_slope": F.round("normalized_slope", 6)})


@query("a32_curve_stats", f"WITH {SERIES} SELECT model, count(value) AS n, arg_max(value, idx) FILTER (WHERE value IS NOT NULL) AS latest, max(value) AS peak, round(avg(value),6) AS mean FROM s GROUP BY 1 HAVING count(value)>0")
def a32(spark, d):
    return curves.statistics(series(spark, d), ["model"]).withColumn("mean", F.round("mean", 6))


@query("a33_chart_bounds", f"WITH {SERIES} SELECT round(greatest(min(value)-greatest((max(value)-min(value))*0.08,0.5),0),6) AS low, round(max(value)+greatest((max(value)-min(value))*0.08,0.5),6) AS high FROM s")
def a33(spark, d):
    b = curves.chart_bounds(series(spark, d))
    return b.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("a34_visible_models", f"WITH {SERIES} SELECT model, max(value) AS peak, arg_max(value, idx) FILTER (WHERE value IS NOT NULL) AS latest FROM s WHERE model<>'click' OR idx<0 GROUP BY 1 HAVING max(value)>0")
def a34(spark, d):
    return curves.visible_models(series(spark, d).where("model <> 'click'"))


END = 1_706_572_800_000_000


def points(spark, d) -> DataFrame:
    return usage_rows(spark, d).select(F.col("ts_us").alias("at_us"), F.when(F.col("k") % 6 != 0, F.col("input").cast("double")).alias("value"), "n")


@query("w13_resample_grid", f"""WITH {USAGE}, p AS (SELECT ts_us-({END}-864000000000) AS off, CAST(input AS DOUBLE) AS value, ts_us FROM usage WHERE k%6<>0 AND ts_us<={END} AND ts_us>={END}-864000000000),
 c AS (SELECT CAST(round(off/600000000.0) AS BIGINT) AS idx, off, value, ts_us FROM p), b AS (SELECT idx, value FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY abs(off-idx*600000000), ts_us) AS rn FROM c) WHERE rn=1)
 SELECT i AS idx, value FROM range(0,1441) t(i) LEFT JOIN b ON b.idx=i""")  # fmt: skip
def w13(spark, d):
    return curves.resample(points(spark, d), END, 864_000, 600).select("idx", "value")


@query("a19_bucketed_series", f"WITH {USAGE}, b AS (SELECT (ts_us-({END}-864000000000))//3600000000 AS idx, round(sum(input)/3600.0,6) AS value FROM usage WHERE k%6<>0 AND ts_us>={END}-864000000000 AND ts_us<{END} GROUP BY 1) SELECT i AS idx, value FROM range(0,240) t(i) LEFT JOIN b ON b.idx=i")
def a19(spark, d):
    return curves.bucketed_mean(points(spark, d), END, 864_000, 3600).select("idx", F.round("value", 6).alias("value"))


@query("a20_day_grid_tps", f"WITH {USAGE}, b AS (SELECT (ts_ms//1800000*1800000-({END}//1000-86400000))//1800000 AS idx, round(sum(output)/1800.0,6) AS value FROM usage GROUP BY 1) SELECT i AS idx, value FROM range(0,48) t(i) LEFT JOIN b ON b.idx=i")
def a20(spark, d):
    from tallyloom.operators.usage import bucket_tokens

    return curves.day_grid(bucket_tokens(usage_rows(spark, d)), END).select("idx", F.round("value", 6).alias("value"))


@query("w15_sparkline")
def w15(spark, d):
    """Resample, fill, smooth and normalise in one."""
    out = curves.sparkline(points(spark, d), END, 86_400, 300, 2)
    return out.select("idx", *[F.round(c, 4).alias(c) for c in ("raw", "value", "normalized")])


@query("w16_span_presets", f"""WITH {USAGE}, v(span, seconds, step, radius) AS (VALUES ('15m', 900, 5, 0), ('1h', 3600, 5, 1), ('24h', 86400, 1800, 0))
 SELECT span, step, radius, CAST(seconds//step - ((SELECT max(ts_ms) FROM usage)-ts_ms)//(1000*step) - 1 AS BIGINT) AS slot, count(*) AS n FROM usage, v WHERE ts_ms>(SELECT max(ts_ms) FROM usage)-1000*seconds GROUP BY 1,2,3,4""")  # fmt: skip
def w16(spark, d):
    """Usage rows by the slots of each span that ends with the newest row."""
    rows = usage_rows(spark, d).select("ts_ms")
    spans = F.array(*[F.struct(F.lit(name).alias("span"), *[F.lit(x).alias(c) for c, x in zip(("seconds", "step", "radius"), v)]) for name, v in curves.SPANS.items()])
    newest = rows.agg(F.max("ts_ms").alias("end_ms"))
    each = rows.crossJoin(F.broadcast(newest)).select("ts_ms", "end_ms", F.explode(spans).alias("s")).where(F.col("ts_ms") > F.col("end_ms") - 1000 * F.col("s.seconds"))
    slot = F.floor(F.col("s.seconds") / F.col("s.step")) - F.floor((F.col("end_ms") - F.col("ts_ms")) / (1000 * F.col("s.step"))) - 1
    return each.groupBy("s.span", "s.step", "s.radius", slot.cast("long").alias("slot")).agg(F.count("*").alias("n"))


@query("p22_numeric_series", f"WITH {USAGE} SELECT n, CASE WHEN k%5 IN (0,1) THEN CAST(input AS DOUBLE) END AS value, CASE WHEN k%5 IN (0,1) THEN coalesce(CASE WHEN k%2=0 THEN output END/5.0, input) END AS short, CASE WHEN k%5 IN (0,1) AND k%2=0 THEN CAST(output AS DOUBLE) END AS second FROM usage")
def p22(spark, d):
    k = F.col("k") % 5
    state = F.when(k == 0, "live").when(k == 1, "zero").otherwise("stale")
    five = F.when(F.col("k") % 2 == 0, F.col("output").cast("double"))
    s = usage_rows(spark, d).select("n", state.alias("state"), F.col("input").cast("double").alias("tps"), five.alias("tokens_5"), five.alias("tokens_1"))
    return s.select("n", curves.numeric_value().alias("value"), curves.short_value().alias("short"), curves.second_value().alias("second"))

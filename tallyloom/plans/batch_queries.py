"""Buckets, summaries, costs, comparisons and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.exprs import display_model, share_or_null
from tallyloom.operators import incremental, usage
from tallyloom.plans.catalogue import query
from tallyloom.plans.tables import BUCKETS, PRICED, SUMS, USAGE, prices
from tallyloom.plans.tables import usage as usage_rows
from tallyloom.schemas import COUNTS

KEYS = ["hostname", "source", "model", "project"]
REF = "make_timestamp(2024,1,30,12,0,0)"
REF_US = 1_706_616_000_000_000
NUMBERS = ", ".join([*COUNTS, "total"])


def ref():
    return F.timestamp_micros(F.lit(REF_US))


def buckets(spark, d) -> DataFrame:
    return usage.bucket_tokens(usage_rows(spark, d), KEYS)


def costed(spark, d) -> DataFrame:
    return usage.with_cost(buckets(spark, d), prices(spark))


def rounded(df: DataFrame, *cs: str, places: int | None = None) -> DataFrame:
    """Costs to three places, other figures to six: sums of doubles differ in their last digits with the order of the rows."""
    return df.withColumns({c: F.round(c, places if places is not None else 3 if c == "cost" else 6) for c in cs})


@query("a01_bucket_tokens", f"WITH {BUCKETS} SELECT * FROM buckets")
def a01(spark, d):
    return buckets(spark, d)


@query("f03_bucket_floor", f"WITH {USAGE} SELECT n, ts_ms//1800000*1800000 AS bucket_start_ms FROM usage")
def f03(spark, d):
    from tallyloom.functions.exprs import bucket_start

    return usage_rows(spark, d).select("n", bucket_start("ts_ms").alias("bucket_start_ms"))


WHERE = {"day": f"bucket_start_ms*1000 >= epoch_us(date_trunc('day',{REF})) AND bucket_start_ms*1000 < epoch_us(date_trunc('day',{REF})+INTERVAL 1 DAY)", "week": f"bucket_start_ms*1000 >= epoch_us({REF}-INTERVAL 168 HOUR) AND bucket_start_ms*1000 < epoch_us({REF})", "month": f"bucket_start_ms*1000 >= epoch_us({REF}-INTERVAL 720 HOUR) AND bucket_start_ms*1000 < epoch_us({REF})", "all": "true"}
COST = "round(sum(cost),3) AS cost"


def _window_queries(w: str) -> None:
    @query(f"a06_summary_{w}", f"WITH {BUCKETS}, {PRICED} SELECT count(*) AS buckets, {SUMS}, {COST} FROM costed WHERE {WHERE[w]} HAVING count(*)>0")
    def _(spark, d):
        return rounded(usage.summary(usage.in_window(costed(spark, d), w, ref())), "cost")

    @query(f"a07_model_summary_{w}", f"WITH {BUCKETS}, {PRICED} SELECT model, {SUMS}, {COST} FROM costed WHERE {WHERE[w]} GROUP BY model")
    def _(spark, d):
        return rounded(usage.model_summary(usage.in_window(costed(spark, d), w, ref())), "cost")


for _w in WHERE:
    _window_queries(_w)


@query("a31_all_windows", f"WITH {BUCKETS}, {PRICED}, m AS (" + " UNION ALL ".join(f"SELECT '{w}' AS \"window\", * FROM costed WHERE {c}" for w, c in WHERE.items()) + f') SELECT "window", model, {SUMS}, {COST} FROM m GROUP BY GROUPING SETS (("window"),("window",model))')
def a31(spark, d):
    return rounded(usage.all_windows(costed(spark, d), ref()), "cost")


@query("f04_summary_host_zone", f"WITH {BUCKETS} SELECT model, {SUMS} FROM buckets WHERE hostname='host1' AND bucket_start_ms*1000 >= epoch_us(make_timestamp(2024,1,30,8,0,0)) AND bucket_start_ms*1000 < epoch_us(make_timestamp(2024,1,31,8,0,0)) GROUP BY model")
def f04(spark, d):
    b = usage.in_window(buckets(spark, d).withColumn("cost", F.lit(0.0)), "day", ref(), "America/Los_Angeles", "host1")
    return usage.model_summary(b).drop("cost")


@query("j06_cost_longest_pattern", f"WITH {BUCKETS}, {PRICED} SELECT model, {SUMS}, {COST} FROM costed WHERE {WHERE['week']} GROUP BY model")
def j06(spark, d):
    return rounded(usage.model_summary(usage.in_window(costed(spark, d), "week", ref())), "cost")


@query("f27_cost_by_bucket", f"WITH {BUCKETS}, {PRICED} SELECT hostname, source, model, project, bucket_start_ms, round(cost,8) AS cost FROM costed")
def f27(spark, d):
    return rounded(costed(spark, d), "cost", places=8).select(*KEYS, "bucket_start_ms", "cost")


@query("a11_cache_rate", f"WITH {USAGE} SELECT model, round(sum(cached_input)/nullif(CAST(sum(cached_input+input) AS DOUBLE),0),6) AS cache_rate FROM usage GROUP BY model")
def a11(spark, d):
    return rounded(usage.cache_rate(usage.model_summary(usage_rows(spark, d).withColumn("cost", F.lit(0.0)))), "cache_rate").select("model", "cache_rate")


DAY_MS = 86_400_000
LO, HI = REF_US // 1000 - DAY_MS, REF_US // 1000


@query("a08_output_buckets", f"WITH {BUCKETS} SELECT bucket_start_ms, CAST(sum(output) AS BIGINT) AS output FROM buckets WHERE bucket_start_ms>={LO} AND bucket_start_ms<{HI} GROUP BY 1")
def a08(spark, d):
    return usage.output_buckets(buckets(spark, d), LO, HI)


@query("a09_output_buckets_by_model", f"WITH {BUCKETS} SELECT bucket_start_ms, model, CAST(sum(output) AS BIGINT) AS output FROM buckets WHERE bucket_start_ms>={LO} AND bucket_start_ms<{HI} GROUP BY 1,2")
def a09(spark, d):
    return usage.output_buckets(buckets(spark, d), LO, HI, by_model=True)


def edits(spark, d):
    u = usage_rows(spark, d)
    return u.select(F.concat(F.lit("t"), F.floor(F.col("n") / 2)).alias("tool_use_id"), "source", "model", "project", "ts_ms", (F.col("k") * 25).alias("added"), F.col("k").alias("deleted"), "file_id", "hostname", (F.col("n") % 3).cast("int").alias("tier"), "n")


EDITS = f"""{USAGE}, edits AS (SELECT 't'||(n//2) AS tool_use_id, source, model, project, ts_ms, k*25 AS added, k AS deleted, file_id, hostname, CAST(n%3 AS INT) AS tier, n FROM usage),
 own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool_use_id ORDER BY tier DESC, ts_ms, file_id) AS rn FROM edits) WHERE rn=1)"""
EDIT_BUCKETS = f"""{EDITS}, eb AS (SELECT source, model, project, ts_ms//1800000*1800000 AS bucket_start_ms, CAST(sum(CASE WHEN added+deleted>2000 THEN 0 ELSE added END) AS BIGINT) AS lines_added,
 CAST(sum(CASE WHEN added+deleted>2000 THEN 0 ELSE deleted END) AS BIGINT) AS lines_deleted FROM own GROUP BY ALL)"""


@query("d04_edit_dedup", f"WITH {EDITS} SELECT tool_use_id, source, model, ts_ms, added, deleted, file_id, tier FROM own")
def d04(spark, d):
    from tallyloom.operators.dedup import edit_dedup

    return edit_dedup(edits(spark, d)).select("tool_use_id", "source", "model", "ts_ms", "added", "deleted", "file_id", "tier")


@query("a10_edit_buckets", f"WITH {EDIT_BUCKETS} SELECT *, lines_added-lines_deleted AS lines_net FROM eb")
def a10(spark, d):
    from tallyloom.operators.dedup import edit_dedup

    return usage.edit_buckets(edit_dedup(edits(spark, d)))


@query("j16_buckets_with_edits", f"""WITH {EDIT_BUCKETS}, tb AS (SELECT source, model, project, ts_ms//1800000*1800000 AS bucket_start_ms, {SUMS} FROM usage GROUP BY ALL)
 SELECT source, model, project, bucket_start_ms, {', '.join(f'coalesce({c},0) AS {c}' for c in [*COUNTS, 'total', 'lines_added', 'lines_deleted'])}, coalesce(lines_added-lines_deleted,0) AS lines_net,
 CAST(CASE WHEN source='src1' OR lines_added IS NOT NULL THEN 2 ELSE 0 END AS INT) AS code_metric_version FROM tb FULL JOIN eb USING (source, model, project, bucket_start_ms)""")  # fmt: skip
def j16(spark, d):
    from tallyloom.operators.dedup import edit_dedup

    tokens = usage.bucket_tokens(usage_rows(spark, d))
    measured = spark.createDataFrame([("src1",)], "source string")
    return usage.buckets_with_edits(tokens, usage.edit_buckets(edit_dedup(edits(spark, d))), measured)


@query("a23_host_totals", f"WITH {BUCKETS} SELECT hostname, count(*) AS buckets, {SUMS}, CAST(sum(greatest(total-cache_creation,0)) AS BIGINT) AS upstream_total, min(bucket_start_ms) AS first_bucket_ms, max(bucket_start_ms) AS last_bucket_ms FROM buckets GROUP BY hostname")
def a23(spark, d):
    return usage.host_totals(buckets(spark, d))


_FIELDS = usage.RECONCILED
_HOSTS = f"hosts AS (SELECT hostname, count(*) AS buckets, {SUMS}, CAST(sum(greatest(total-cache_creation,0)) AS BIGINT) AS upstream_total, min(bucket_start_ms) AS first_bucket_ms, max(bucket_start_ms) AS last_bucket_ms FROM buckets GROUP BY hostname)"
_LONG = " UNION ALL ".join(f"SELECT l.hostname, '{f}' AS field, CAST(l.{f} AS BIGINT) AS local, CAST(r.{f} AS BIGINT) AS remote, r.hostname IS NULL AS gone FROM hosts l LEFT JOIN remote r ON l.hostname=r.hostname" for f in _FIELDS)


@query("j09_reconcile", f"WITH {BUCKETS}, {_HOSTS}, remote AS (SELECT * REPLACE (output+1 AS output) FROM hosts WHERE hostname='host0'), long AS ({_LONG}) SELECT hostname, field, CAST(local AS VARCHAR) AS local, CAST(remote AS VARCHAR) AS remote, CASE WHEN gone THEN 'missing' WHEN local IS NOT DISTINCT FROM remote THEN 'match' ELSE 'mismatch' END AS status FROM long")
def j09(spark, d):
    local = usage.host_totals(buckets(spark, d))
    out = usage.reconcile(local, local.where("hostname = 'host0'").withColumn("output", F.col("output") + 1))
    return out.withColumns({c: F.col(c).cast("string") for c in ("local", "remote")})


@query("s23_reconcile_report")
def s23(spark, d):
    return usage.reconcile_report(j09(spark, d))


@query("o09_top3_share", f"WITH {USAGE}, m AS (SELECT model, CAST(sum(total) AS BIGINT) AS total FROM usage GROUP BY model) SELECT model, total, round(total/CAST((SELECT sum(total) FROM m) AS DOUBLE),6) AS share, CAST(greatest((SELECT count(*) FROM m)-3,0) AS BIGINT) AS hidden FROM m WHERE total>0 ORDER BY total DESC, model LIMIT 3")
def o09(spark, d):
    m = usage.model_summary(usage_rows(spark, d).withColumn("cost", F.lit(0.0)))
    return rounded(usage.top_models(m), "share")


_ANCHOR = """a AS (SELECT 'click' AS model, 3000000 AS t, 1000000 AS a UNION ALL SELECT 'view', 5, 9000000000 UNION ALL SELECT 'new', 70, 0)"""


@query("j08_anchored_offset", f"""WITH {USAGE}, real AS (SELECT model, CAST(sum(total) AS BIGINT) AS total FROM usage GROUP BY model), {_ANCHOR},
 w AS (SELECT model, coalesce(t,0)+coalesce(total,0)-coalesce(a,0) AS want FROM real FULL JOIN a USING (model)),
 s AS (SELECT model, greatest(want,0) AS total FROM w UNION ALL SELECT 'other', sum(least(want,0)) FROM w)
 SELECT model, CAST(greatest(sum(total),0) AS BIGINT) AS total FROM s GROUP BY model HAVING sum(total)>0""")  # fmt: skip
def j08(spark, d):
    real = usage.model_summary(usage_rows(spark, d).withColumn("cost", F.lit(0.0)))
    target = spark.createDataFrame([("click", 3_000_000), ("view", 5), ("new", 70)], "model string, total long")
    anchor = spark.createDataFrame([("click", 1_000_000), ("view", 9_000_000_000), ("new", 0)], "model string, total long")
    return usage.anchored(real, target, anchor)


def versioned(spark, d):
    b = buckets(spark, d).withColumn("revision", (F.col("total") % 50).cast("long"))
    return b.withColumn("synced_revision", F.when(F.col("input") % 3 == 0, F.col("revision")).otherwise(F.lit(0)).cast("long"))


VERSIONED = f"{BUCKETS}, v AS (SELECT *, total%50 AS revision, CASE WHEN input%3=0 THEN total%50 ELSE 0 END AS synced_revision FROM buckets)"
PAGE = ["bucket_start_ms", "source", "model", "project", "hostname"]


@query("o01_pending_page", f"WITH {VERSIONED} SELECT revision, bucket_start_ms, source, model, project, hostname, true AS has_more FROM v WHERE revision>synced_revision AND bucket_start_ms>=0 ORDER BY revision, bucket_start_ms, source, model, project, hostname LIMIT 200")
def o01(spark, d):
    return incremental.pending(versioned(spark, d), PAGE, 200, "bucket_start_ms").select("revision", *PAGE, "has_more")


@query("j15_acknowledge", f"""WITH {VERSIONED}, sent AS (SELECT *, CASE WHEN output%5=0 THEN revision-1 ELSE revision END AS sent_revision FROM v WHERE revision>synced_revision AND total%2=0)
 SELECT hostname, source, model, project, bucket_start_ms, v.revision, CAST(CASE WHEN s.sent_revision=v.revision THEN greatest(v.synced_revision, v.revision) ELSE v.synced_revision END AS BIGINT) AS synced_revision
 FROM v LEFT JOIN (SELECT hostname, source, model, project, bucket_start_ms, sent_revision FROM sent) s USING (hostname, source, model, project, bucket_start_ms)""")  # fmt: skip
def j15(spark, d):
    v, keys = versioned(spark, d), [*KEYS, "bucket_start_ms"]
    sent = v.where("revision > synced_revision and total % 2 = 0").withColumn("revision", F.when(F.col("output") % 5 == 0, F.col("revision") - 1).otherwise(F.col("revision")))
    return incremental.acknowledge(v, sent, keys).select(*keys, "revision", "synced_revision")


@query("a24_high_watermarks", f"WITH {VERSIONED} SELECT hostname, max(revision) AS revision FROM (SELECT hostname, revision FROM v UNION ALL SELECT 'host'||(n%3), n FROM usage) GROUP BY 1")
def a24(spark, d):
    s = usage_rows(spark, d).select(F.concat(F.lit("host"), F.col("n") % 3).alias("hostname"), F.col("n").alias("revision"))
    return incremental.high_watermarks(versioned(spark, d), s)


@query("m11_batch_chunks", f"""WITH {USAGE}, b AS (SELECT (row_number() OVER (ORDER BY n)-1)//70 AS batch FROM usage), s AS (SELECT (row_number() OVER (ORDER BY n)-1)//40 AS batch FROM usage),
 x AS (SELECT batch, count(*) AS buckets FROM b GROUP BY 1), y AS (SELECT batch, count(*) AS sessions FROM s GROUP BY 1)
 SELECT CAST(batch AS BIGINT) AS batch, coalesce(buckets,0) AS buckets, coalesce(sessions,0) AS sessions FROM x FULL JOIN y USING (batch)""")  # fmt: skip
def m11(spark, d):
    u = usage_rows(spark, d)
    return incremental.batches(u, u, ["n"], ["n"], 70, 40)


@query("d08_natural_key_guard", f"WITH {USAGE} SELECT source, model, project, count(*) AS copies FROM usage GROUP BY 1,2,3 HAVING count(*)>1")
def d08(spark, d):
    from tallyloom.operators.dedup import duplicate_keys

    return duplicate_keys(usage_rows(spark, d), ["source", "model", "project"])


@query("p25_dynamic_predicate", f"WITH {BUCKETS} SELECT count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM buckets WHERE hostname='host0' AND bucket_start_ms>={LO} AND bucket_start_ms<{HI}")
def p25(spark, d):
    b = buckets(spark, d).where((F.col("hostname") == "host0") & (F.col("bucket_start_ms") >= LO) & (F.col("bucket_start_ms") < HI))
    return b.agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@query("p30_display_model", f"WITH {USAGE} SELECT CASE WHEN n%9=0 OR n%11=0 THEN '(none)' ELSE model END AS shown, count(*) AS n FROM usage GROUP BY 1")
def p30(spark, d):
    m = F.when(F.col("n") % 9 == 0, "").when(F.col("n") % 11 == 0, "<synthetic>").otherwise(F.col("model"))
    return usage_rows(spark, d).select(display_model(m).alias("shown")).groupBy("shown").agg(F.count("*").alias("n"))


@query("s19_bucket_payload", f"WITH {BUCKETS} SELECT source, model, project, hostname, strftime(make_timestamp(bucket_start_ms*1000),'%Y-%m-%dT%H:%M:%SZ') AS bucket_start, total FROM buckets")
def s19(spark, d):
    from tallyloom.sources.payloads import bucket_payloads

    return bucket_payloads(buckets(spark, d)).select("source", "model", "project", "hostname", "bucket_start", "total")


@query("u06_concat_sources", f"WITH {USAGE} SELECT origin, count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM (SELECT 'log' AS origin, total FROM usage WHERE n%2=0 UNION ALL SELECT 'api', total FROM usage WHERE n%2=1) GROUP BY 1")
def u06(spark, d):
    u = usage_rows(spark, d)
    both = u.where("n % 2 = 0").select(F.lit("log").alias("origin"), "total", "file_id").unionByName(u.where("n % 2 = 1").select(F.lit("api").alias("origin"), "total"), allowMissingColumns=True)
    return both.groupBy("origin").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@query("x_share_of_orders", "SELECT o_orderpriority, round(sum(l_discount*l_extendedprice)/sum(l_extendedprice),6) AS share, count(*) AS n FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1")
def x_share(spark, d):
    """A wide join at scale: line items with their orders."""
    li, o = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    j = li.select("l_orderkey", "l_discount", "l_extendedprice").join(o.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = j.groupBy("o_orderpriority").agg(F.sum(F.col("l_discount") * F.col("l_extendedprice")).alias("a"), F.sum("l_extendedprice").alias("b"), F.count("*").alias("n"))
    return out.select("o_orderpriority", F.round(share_or_null("a", "b"), 6).alias("share"), "n")

"""Deduplication, sessions, incremental maintenance, set operations and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import dedup, incremental, rate, sessions, tasks
from tallyloom.plans.catalogue import query
from tallyloom.plans.tables import BUCKETS, RAW, SEGMENTS, SESSIONS, USAGE, raw_copies, session_events, table
from tallyloom.plans.tables import usage as usage_rows
from tallyloom.schemas import COUNTS

TOP = f"{RAW}, best AS (SELECT * FROM (SELECT *, max(tier) OVER (PARTITION BY source, event_id) AS top FROM raw) WHERE tier=top)"
FIRST = "ORDER BY ts_ms, event_id, file_id"
DEDUP = f"""{TOP}, numbered AS (SELECT *, row_number() OVER (PARTITION BY source, event_id {FIRST}) AS rn FROM best),
 dd AS (SELECT source, event_id, tier, max(input) AS input, max(output) AS output, max(cached_input) AS cached_input, max(cache_creation) AS cache_creation, max(reasoning) AS reasoning,
 greatest(max(total), max(input)+max(output)+max(cached_input)+max(cache_creation)+max(reasoning)) AS total,
 coalesce(arg_min(model, rn) FILTER (WHERE lower(model) NOT IN ('','unknown')),'unknown') AS model, bool_and(inherited) AS inherited, bool_or(has_total_snapshot) AS has_total_snapshot,
 coalesce(arg_min(lineage_fingerprint, rn) FILTER (WHERE lineage_fingerprint<>''),'') AS lineage_fingerprint, coalesce(arg_min(dedup_key, rn) FILTER (WHERE dedup_key<>''),'') AS dedup_key,
 arg_min(file_id, rn) AS file_id, arg_min(ts_ms, rn) AS ts_ms, arg_min(session_hash, rn) AS session_hash, arg_min(project, rn) AS project FROM numbered GROUP BY source, event_id, tier)"""
SHOWN = ["source", "event_id", "tier", *COUNTS, "total", "model", "inherited", "has_total_snapshot", "file_id", "ts_ms", "project"]


def folded(spark, d) -> DataFrame:
    return dedup.tier_dedup(raw_copies(spark, d))


@query("d02_tier_dedup", f"WITH {DEDUP} SELECT {', '.join(SHOWN)}, lineage_fingerprint, dedup_key FROM dd")
def d02(spark, d):
    return folded(spark, d).select(*SHOWN, "lineage_fingerprint", "dedup_key")


LINEAGE = f"""{DEDUP}, lf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lineage_fingerprint ORDER BY inherited, ts_ms, event_id, file_id) AS rk, count(*) OVER (PARTITION BY lineage_fingerprint) AS copies FROM dd WHERE lineage_fingerprint<>'') WHERE rk=1
 UNION ALL SELECT *, 1, 1 FROM dd WHERE lineage_fingerprint='')"""


@query("d06_lineage_fold", f"WITH {LINEAGE} SELECT {', '.join(SHOWN)}, copies FROM lf")
def d06(spark, d):
    return dedup.lineage_fold(folded(spark, d)).select(*SHOWN, "copies")


@query("d07_content_fold", f"""WITH {LINEAGE}, x AS (SELECT * EXCLUDE (rk, copies) FROM lf), cf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY input+output+cached_input+cache_creation+reasoning DESC, ts_ms, event_id, file_id) AS rk,
 count(*) OVER (PARTITION BY dedup_key) AS copies FROM x WHERE dedup_key<>'') WHERE rk=1 UNION ALL SELECT *, 1, 1 FROM x WHERE dedup_key='') SELECT {', '.join(SHOWN)}, copies FROM cf""")  # fmt: skip
def d07(spark, d):
    return dedup.content_fold(dedup.lineage_fold(folded(spark, d))).select(*SHOWN, "copies")


@query("d03_overwrite_conflicts", f"""WITH {TOP}, own AS (SELECT * REPLACE (CASE WHEN n%30=0 AND file_id='a_copy' THEN 'other' ELSE session_hash END AS session_hash) FROM best)
 SELECT source, event_id, count(DISTINCT session_hash) AS sessions, count(DISTINCT model) FILTER (WHERE lower(model) NOT IN ('','unknown')) AS models, count(DISTINCT project) AS projects FROM own GROUP BY 1,2
 HAVING count(DISTINCT session_hash)>1 OR count(DISTINCT model) FILTER (WHERE lower(model) NOT IN ('','unknown'))>1""")  # fmt: skip
def d03(spark, d):
    raw = raw_copies(spark, d).withColumn("session_hash", F.when((F.col("n") % 30 == 0) & (F.col("file_id") == "a_copy"), "other").otherwise(F.col("session_hash")))
    return dedup.overwrite_conflicts(raw)


@query("d01_upsert_merge", f"""WITH {USAGE}, w AS (SELECT file_id, 'k'||(n//21) AS event_id, n AS seq, CASE WHEN (n//21)%2=0 THEN 'overwrite' ELSE 'cumulativeMax' END AS merge_strategy, CASE WHEN n%2=0 THEN 'unknown' ELSE model END AS model, input, output, cached_input, cache_creation, reasoning, total, ts_ms FROM usage)
 SELECT file_id, event_id, CASE WHEN any_value(merge_strategy)='overwrite' THEN arg_max(input,seq) ELSE max(input) END AS input, CASE WHEN any_value(merge_strategy)='overwrite' THEN arg_max(total,seq) ELSE max(total) END AS total,
 CASE WHEN any_value(merge_strategy)='overwrite' THEN arg_max(model,seq) ELSE coalesce(arg_max(model,seq) FILTER (WHERE model<>'unknown'),'unknown') END AS model, arg_max(ts_ms,seq) AS ts_ms FROM w GROUP BY 1,2""")  # fmt: skip
def d01(spark, d):
    strategy = F.when(F.floor(F.col("n") / 21) % 2 == 0, "overwrite").otherwise("cumulativeMax")
    u = usage_rows(spark, d).select("file_id", F.concat(F.lit("k"), F.floor(F.col("n") / 21)).alias("event_id"), F.col("n").alias("seq"), strategy.alias("merge_strategy"), F.when(F.col("n") % 2 == 0, "unknown").otherwise(F.col("model")).alias("model"), *COUNTS, "total", "ts_ms")
    return dedup.merge_upserts(u).select("file_id", "event_id", "input", "total", "model", "ts_ms")


@query("j04_attribution_tier", f"WITH {USAGE}, files AS (SELECT 'f'||i AS file_id, CASE WHEN i%2=0 THEN 'complete' ELSE 'missing' END AS status FROM range(5) t(i)), r AS (SELECT n, CASE WHEN n%13=0 THEN '' ELSE file_id END AS file_id FROM usage) SELECT n, CAST(CASE WHEN r.file_id='' THEN 0 WHEN status IS NOT NULL AND status<>'missing' THEN 2 ELSE 1 END AS INT) AS tier FROM r LEFT JOIN files USING (file_id)")
def j04(spark, d):
    files = spark.createDataFrame([(f"f{i}", "complete" if i % 2 == 0 else "missing") for i in range(5)], "file_id string, status string")
    return dedup.with_tier(usage_rows(spark, d).select("n", F.when(F.col("n") % 13 == 0, "").otherwise(F.col("file_id")).alias("file_id")), files).select("n", "tier")


@query("d05_session_event_dedup", f"WITH {RAW}, x AS (SELECT source, 'v'||(n//2) AS event_id, tier, file_id, ts_ms, n FROM raw) SELECT source, event_id, tier, file_id, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY source, event_id ORDER BY tier DESC, file_id, ts_ms) AS rn FROM x) WHERE rn=1")
def d05(spark, d):
    rows = raw_copies(spark, d).select("source", F.concat(F.lit("v"), F.floor(F.col("n") / 2)).alias("event_id"), "tier", "file_id", "ts_ms")
    return dedup.session_event_dedup(rows)


@query("d11_first_line_wins", f"WITH {USAGE} SELECT file_id, 'i'||(n//10) AS item, min(n) AS line_no FROM usage GROUP BY 1,2")
def d11(spark, d):
    rows = usage_rows(spark, d).select("file_id", F.concat(F.lit("i"), F.floor(F.col("n") / 10)).alias("item"), F.col("n").alias("line_no"))
    return dedup.first_by(rows, ["file_id", "item"], [F.col("line_no")])


@query("w04_occurrence_ordinal", f"WITH {USAGE}, b AS (SELECT file_id, n, model||(k%5) AS base FROM usage), o AS (SELECT *, row_number() OVER (PARTITION BY file_id, base ORDER BY n)-1 AS o FROM b) SELECT n, CASE WHEN o=0 THEN base ELSE base||'#'||o END AS event_id FROM o")
def w04(spark, d):
    rows = usage_rows(spark, d).select("file_id", "n", F.concat("model", (F.col("k") % 5).cast("string")).alias("base"))
    return dedup.occurrence_ids(rows, "file_id", "base", "n").select("n", "event_id")


# -- sessions ------------------------------------------------------------------------------------


@query("w05_session_active_seconds", f"WITH {SEGMENTS} SELECT * FROM active")
def w05(spark, d):
    return sessions.active_seconds(session_events(spark, d))


_HOURS = ", ".join(f"count(*) FILTER (WHERE (ts_ms//3600000)%24={h}) AS h{h}" for h in range(24))


@query("a05_session_aggregate", f"""WITH {SEGMENTS}, g AS (SELECT source, session_hash, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS message_count, count(*) FILTER (WHERE role='user') AS user_message_count,
 count(*) FILTER (WHERE role='assistant') AS assistant_events, {_HOURS} FROM se GROUP BY 1,2) SELECT g.*, coalesce(active_seconds,0) AS active_seconds FROM g LEFT JOIN active USING (source, session_hash)""")  # fmt: skip
def a05(spark, d):
    out = sessions.session_aggregate(session_events(spark, d))
    return out.select("*", *[F.col("hour_histogram")[h].alias(f"h{h}") for h in range(24)]).drop("hour_histogram")


@query("w09_latest_project", f"WITH {USAGE} SELECT source, session_hash, project FROM (SELECT *, row_number() OVER (PARTITION BY source, session_hash ORDER BY ts_ms DESC, event_id, file_id) AS rn FROM usage) WHERE rn=1")
def w09(spark, d):
    return sessions.latest_project(usage_rows(spark, d))


@query("j05_sessions_with_project", f"WITH {SESSIONS}, p AS (SELECT source, session_hash, arg_min(project, ts_ms) AS project FROM (SELECT 'talk' AS source, CAST(conv_id AS VARCHAR) AS session_hash, 'p'||conv_id AS project, turn AS ts_ms FROM conversations WHERE conv_id%3=0) GROUP BY 1,2), s AS (SELECT source, session_hash, count(*) AS n FROM se GROUP BY 1,2) SELECT source, session_hash, n, coalesce(project,'unknown') AS project FROM s LEFT JOIN p USING (source, session_hash)")
def j05(spark, d):
    se = session_events(spark, d)
    s = se.groupBy("source", "session_hash").agg(F.count("*").alias("n"))
    p = se.where("cast(session_hash as long) % 3 = 0").groupBy("source", "session_hash").agg(F.first(F.concat(F.lit("p"), "session_hash")).alias("project"))
    none = spark.createDataFrame([], "source string, session_hash string, skills array<string>")
    return sessions.sessions_with_dims(s, p, none).drop("skills")


# -- counters and carried values -----------------------------------------------------------------

COUNTER = f"{USAGE}, c AS (SELECT file_id, n, CASE WHEN n%11=0 THEN NULL ELSE sum(input) OVER (PARTITION BY file_id, n//700 ORDER BY n) END AS total, CASE WHEN n%11=0 THEN NULL ELSE sum(output) OVER (PARTITION BY file_id, n//700 ORDER BY n) END AS output FROM usage)"


def counters(spark, d) -> DataFrame:
    w = Window.partitionBy("file_id", F.floor(F.col("n") / 700)).orderBy("n")
    gap = F.col("n") % 11 == 0
    return usage_rows(spark, d).select("file_id", "n", F.when(~gap, F.sum("input").over(w)).alias("total"), F.when(~gap, F.sum("output").over(w)).alias("output"))


@query("w01_counter_delta_reset", f"""WITH {COUNTER}, p AS (SELECT *, last_value(total IGNORE NULLS) OVER w AS pt, last_value(output IGNORE NULLS) OVER w AS po FROM c WINDOW w AS (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT file_id, n, CAST(CASE WHEN pt IS NULL OR total<pt OR output<po THEN total ELSE greatest(total-pt,0) END AS BIGINT) AS d_total, CAST(CASE WHEN pt IS NULL OR total<pt OR output<po THEN output ELSE greatest(output-po,0) END AS BIGINT) AS d_output FROM p WHERE total IS NOT NULL""")  # fmt: skip
def w01(spark, d):
    return rate.counter_steps(counters(spark, d), "file_id", "n", ["output"], "total").where("total is not null").select("file_id", "n", "d_total", "d_output")


@query("t12_counter_intervals", f"""WITH {COUNTER}, x AS (SELECT c.*, ts_us FROM c JOIN (SELECT n, ts_us FROM usage) USING (n) WHERE total IS NOT NULL), p AS (SELECT *, lag(total) OVER w AS pt, lag(ts_us) OVER w AS ps FROM x WINDOW w AS (PARTITION BY file_id ORDER BY n))
 SELECT file_id, ps AS start_us, ts_us AS end_us, CAST(total-pt AS BIGINT) AS tokens FROM p WHERE ps IS NOT NULL AND total>pt AND ts_us-ps<=3600000000""")  # fmt: skip
def t12(spark, d):
    rows = counters(spark, d).where("total is not null").join(usage_rows(spark, d).select("n", F.col("ts_us").alias("at_us")), "n")
    return rate.counter_deltas(rows, "file_id", "n", "total", 3_600_000_000).select("file_id", "start_us", "end_us", "tokens")


@query("w02_carry_forward_model", f"WITH {USAGE} SELECT n, last_value(CASE WHEN k%9=0 THEN model END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS model FROM usage")
def w02(spark, d):
    w = Window.partitionBy("file_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return usage_rows(spark, d).select("n", F.last(F.when(F.col("k") % 9 == 0, F.col("model")), ignorenulls=True).over(w).alias("model"))


@query("w03_inherited_prefix", f"WITH {USAGE} SELECT n, coalesce(max(CASE WHEN k%9=0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)=0 AS inherited FROM usage")
def w03(spark, d):
    w = Window.partitionBy("file_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return usage_rows(spark, d).select("n", (F.coalesce(F.max((F.col("k") % 9 == 0).cast("int")).over(w), F.lit(0)) == 0).alias("inherited"))


@query("w07_backfill_final_model", f"WITH {USAGE}, m AS (SELECT n, file_id, CASE WHEN k%9=0 THEN model END AS m FROM usage), l AS (SELECT file_id, arg_max(m, n) FILTER (WHERE m IS NOT NULL) AS final FROM m GROUP BY 1) SELECT n, coalesce(m, final) AS model FROM m JOIN l USING (file_id)")
def w07(spark, d):
    m = usage_rows(spark, d).select("n", "file_id", F.when(F.col("k") % 9 == 0, F.col("model")).alias("m"))
    last = m.groupBy("file_id").agg(F.max_by("m", F.when(F.col("m").isNotNull(), F.col("n"))).alias("final"))
    return m.join(last, "file_id").select("n", F.coalesce("m", "final").alias("model"))


@query("w08_last_lifecycle", f"WITH {USAGE}, l AS (SELECT file_id, n, CASE k%4 WHEN 0 THEN 'task_started' WHEN 1 THEN 'task_complete' WHEN 2 THEN 'turn_aborted' ELSE 'note' END AS event FROM usage) SELECT file_id, arg_max(event, n) AS lifecycle FROM l WHERE event<>'note' GROUP BY 1")
def w08(spark, d):
    return tasks.last_lifecycle(lifecycle_lines(spark, d))


def lifecycle_lines(spark, d) -> DataFrame:
    k = F.col("k") % 4
    event = F.when(k == 0, "task_started").when(k == 1, "task_complete").when(k == 2, "turn_aborted").otherwise("note")
    turn = F.when(F.col("n") % 5 != 0, F.concat(F.lit("t"), F.floor(F.col("n") / 12)))
    return usage_rows(spark, d).select("file_id", F.col("n").alias("line_no"), event.alias("event"), F.col("session_hash").alias("session"), turn.alias("turn_id"), "source")


@query("a12_completed_tasks", f"WITH {USAGE} SELECT source, count(DISTINCT session_hash||'/'||CASE WHEN n%5<>0 THEN 't'||(n//12) ELSE 'line:'||n END) AS completed FROM usage WHERE k%4=1 GROUP BY 1")
def a12(spark, d):
    return tasks.completed_tasks(lifecycle_lines(spark, d), ["source"])


@query("a13_sessions_by_category", f"WITH {USAGE} SELECT source AS category, count(DISTINCT session_hash) AS total, count(DISTINCT session_hash) FILTER (WHERE ts_us>=(SELECT max(ts_us) FROM usage)-86400000000) AS active FROM usage GROUP BY 1")
def a13(spark, d):
    u = usage_rows(spark, d).select(F.col("source").alias("category"), F.col("session_hash").alias("session"), F.col("ts_us").alias("activity_us"))
    now = u.agg(F.max("activity_us").alias("now"))
    return tasks.sessions_by_category(u.crossJoin(F.broadcast(now)), F.col("now"), 86_400)


@query("a14_active_desktop", f"WITH {USAGE}, m AS (SELECT session_hash AS session, arg_max(struct_pack(r := CASE WHEN k%3=0 THEN 'user' ELSE 'assistant' END, s := CASE k%4 WHEN 0 THEN 'end_turn' WHEN 1 THEN 'tool_use' END, a := ts_us), n) AS m FROM usage GROUP BY 1) SELECT session, m.r AS role, m.a AS at_us FROM m WHERE (m.r='user' OR m.s IS NULL OR m.s='tool_use') AND (SELECT max(ts_us) FROM usage)-m.a<=3600000000")
def a14(spark, d):
    stop = F.when(F.col("k") % 4 == 0, "end_turn").when(F.col("k") % 4 == 1, "tool_use")
    u = usage_rows(spark, d).select(F.col("session_hash").alias("session"), F.when(F.col("k") % 3 == 0, "user").otherwise("assistant").alias("role"), stop.alias("stop_reason"), F.col("ts_us").alias("at_us"), F.col("n").alias("line_no"))
    now = u.agg(F.max("at_us")).first()[0] or 0
    return tasks.active_desktop(u, now, 3600)


@query("a29_source_status", f"WITH {USAGE}, l AS (SELECT source, file_id, arg_max(k%4, n) FILTER (WHERE k%4<3) AS last FROM usage GROUP BY 1,2) SELECT source, count(*) FILTER (WHERE last=0) AS open_turns, CASE WHEN source='src2' THEN 'notRunning' WHEN count(*) FILTER (WHERE last=0)>0 THEN 'generating' ELSE 'idle' END AS status FROM l GROUP BY 1")
def a29(spark, d):
    l = lifecycle_lines(spark, d).withColumn("file_id", F.concat("source", "file_id"))  # noqa: E741
    f = tasks.last_lifecycle(l).withColumn("source", F.left("file_id", F.lit(4))).withColumns({"completed": F.lit(0), "parsed": F.lit(True)})
    r = tasks.source_rollup(f)
    return r.select("source", "open_turns", tasks.source_status(F.col("source") != "src2", F.col("open_turns"), F.lit(False)).alias("status"))


@query("a30_source_rollup", f"WITH {USAGE}, l AS (SELECT source, file_id, arg_max(k%4, n) FILTER (WHERE k%4<3) AS last, count(DISTINCT session_hash) FILTER (WHERE k%4=1) AS completed FROM usage GROUP BY 1,2) SELECT source, CAST(sum(completed) AS BIGINT) AS completed, count(*) FILTER (WHERE last=0) AS open_turns, 'partial' AS quality FROM l GROUP BY 1")
def a30(spark, d):
    l = lifecycle_lines(spark, d).withColumn("file_id", F.concat("source", "file_id"))  # noqa: E741
    done = l.where("event = 'task_complete'").groupBy("file_id").agg(F.count_distinct("session").alias("completed"))
    files = tasks.last_lifecycle(l).join(done, "file_id", "left").withColumns({"source": F.left("file_id", F.lit(4)), "parsed": F.lit(True), "completed": F.coalesce("completed", F.lit(0))})
    return tasks.source_rollup(files)


@query("o10_rank_categories", f"WITH {USAGE}, c AS (SELECT model, count(DISTINCT session_hash) AS total, count(DISTINCT session_hash) FILTER (WHERE k<20) AS active FROM usage GROUP BY 1) SELECT model, total, active FROM c WHERE active>0 ORDER BY active DESC, total DESC, model LIMIT 4")
def o10(spark, d):
    u = usage_rows(spark, d).groupBy("model").agg(F.count_distinct("session_hash").alias("total"), F.count_distinct(F.when(F.col("k") < 20, F.col("session_hash"))).alias("active"))
    return tasks.rank_categories(u.withColumns({"present": F.lit(True), "place": F.col("model")})).select("model", "total", "active")


@query("j07_live_registered", f"WITH {USAGE}, r AS (SELECT n AS pid, n+(CASE WHEN n%7=0 THEN 1 ELSE 0 END) AS file_pid, session_hash FROM usage) SELECT count(DISTINCT session_hash) AS sessions, count(*) AS n FROM r WHERE pid=file_pid AND pid IN (SELECT n*3 FROM usage)")
def j07(spark, d):
    u = usage_rows(spark, d)
    registry = u.select(F.col("n").alias("pid"), (F.col("n") + F.when(F.col("n") % 7 == 0, 1).otherwise(0)).alias("file_pid"), "session_hash")
    return tasks.live_registered(u.select((F.col("n") * 3).alias("pid")), registry).agg(F.count_distinct("session_hash").alias("sessions"), F.count("*").alias("n"))


# -- joins by key, tool calls --------------------------------------------------------------------

CALLS = f"{USAGE}, calls AS (SELECT file_id, 'c'||(n//4) AS call_id, n AS line_no, k AS added FROM usage WHERE n%4<2), outs AS (SELECT file_id, 'c'||((n*7)//4%2500) AS call_id, n AS line_no, k%3<>0 AS ok FROM usage WHERE n%4>=2)"


@query("j01_call_output_gate", f"WITH {CALLS}, c AS (SELECT file_id, call_id, arg_max(added, line_no) AS added FROM calls GROUP BY 1,2), o AS (SELECT file_id, call_id, arg_max(ok, line_no) AS ok FROM outs GROUP BY 1,2) SELECT file_id, call_id, added FROM c JOIN o USING (file_id, call_id) WHERE ok")
def j01(spark, d):
    from tallyloom.operators.calls import gated_calls

    u = usage_rows(spark, d).withColumn("line_no", F.col("n"))
    cid = lambda x: F.concat(F.lit("c"), x.cast("string"))
    calls = u.where("n % 4 < 2").select("file_id", cid(F.floor(F.col("n") / 4)).alias("call_id"), "line_no", F.col("k").alias("added"))
    outs = u.where("n % 4 >= 2").select("file_id", cid(F.floor(F.col("n") * 7 / 4) % 2500).alias("call_id"), "line_no", (F.col("k") % 3 != 0).alias("ok"))
    return gated_calls(calls, outs, ["added"]).select("file_id", "call_id", "added")


# -- maintenance ---------------------------------------------------------------------------------

DIFF = f"""{BUCKETS}, o AS (SELECT hostname, source, model, project, bucket_start_ms, total+(CASE WHEN total%5=0 THEN 1 ELSE 0 END) AS total, input, total%9+1 AS revision FROM buckets WHERE total%7<>0), nw AS (SELECT hostname, source, model, project, bucket_start_ms, total, input FROM buckets WHERE total%11<>0)"""
KEY = ["hostname", "source", "model", "project", "bucket_start_ms"]


@query("j11_diff_revision", f"""WITH {DIFF} SELECT hostname, source, model, project, bucket_start_ms, nw.total AS total, CASE WHEN o.revision IS NULL THEN 'insert' WHEN o.total<>nw.total OR o.input<>nw.input THEN 'update' ELSE 'unchanged' END AS change,
 CAST(CASE WHEN o.revision IS NULL OR o.total<>nw.total OR o.input<>nw.input THEN 100 ELSE o.revision END AS BIGINT) AS revision FROM nw LEFT JOIN o USING (hostname, source, model, project, bucket_start_ms)""")  # fmt: skip
def j11(spark, d):
    from tallyloom.plans.batch_queries import buckets

    b = buckets(spark, d)
    old = b.where("total % 7 <> 0").withColumns({"revision": F.col("total") % 9 + 1, "synced_revision": F.lit(0).cast("long"), "total": F.col("total") + F.when(F.col("total") % 5 == 0, 1).otherwise(0)})
    changes = incremental.diff(old, b.where("total % 11 <> 0"), KEY, ["total", "input"])
    bumped = F.when(F.col("change").isin("insert", "update"), F.lit(100)).otherwise(F.col("revision")).cast("long")
    return changes.where("change <> 'delete'").select(*KEY, "total", "change", bumped.alias("revision"))


@query("m01_recompute_frozen", f"""WITH {DIFF}, line AS (SELECT 1705320000000 AS ms), j AS (SELECT hostname, source, model, project, bucket_start_ms, nw.total AS nt, nw.input AS ni, o.total AS ot, o.input AS oi, o.revision FROM nw FULL JOIN o USING (hostname, source, model, project, bucket_start_ms))
 SELECT hostname, source, model, project, bucket_start_ms, nt AS total, CAST(CASE WHEN revision IS NULL OR nt<>ot OR ni<>oi THEN 501 ELSE revision END AS BIGINT) AS revision FROM j WHERE nt IS NOT NULL AND bucket_start_ms>=(SELECT ms FROM line)
 UNION ALL SELECT hostname, source, model, project, bucket_start_ms, total, revision FROM o WHERE bucket_start_ms<(SELECT ms FROM line)""")  # fmt: skip
def m01(spark, d):
    from tallyloom.plans.batch_queries import buckets

    b = buckets(spark, d)
    old = b.where("total % 7 <> 0").withColumns({"revision": F.col("total") % 9 + 1, "synced_revision": F.lit(0).cast("long"), "total": F.col("total") + F.when(F.col("total") % 5 == 0, 1).otherwise(0)})
    out, _ = incremental.recompute(old, b.where("total % 11 <> 0"), KEY, ["total", "input"], 500, 1_705_320_000_000)
    return out.select(*KEY, "total", "revision")


FILES = f"{USAGE}, files AS (SELECT 'g'||n AS file_id, source, CASE n%5 WHEN 0 THEN 'missing' WHEN 1 THEN 'degraded' ELSE 'complete' END AS status, total AS size, ts_ms AS mtime_ms, CAST(8+n%2 AS INT) AS parser_version, n FROM usage)"


def files(spark, d) -> DataFrame:
    n = F.col("n")
    status = F.when(n % 5 == 0, "missing").when(n % 5 == 1, "degraded").otherwise("complete")
    return usage_rows(spark, d).select(F.concat(F.lit("g"), n.cast("string")).alias("file_id"), "source", status.alias("status"), F.col("total").alias("size"), F.col("ts_ms").alias("mtime_ms"), (F.lit(8) + n % 2).cast("int").alias("parser_version"), "n")


@query("j12_semi_probe", f"WITH {FILES} SELECT count(*) AS n FROM usage WHERE k<5 AND EXISTS (SELECT 1 FROM files WHERE files.n=usage.n AND status<>'missing')")
def j12(spark, d):
    there = files(spark, d).where("status <> 'missing'").select("n")
    return usage_rows(spark, d).where("k < 5").join(there, "n", "left_semi").agg(F.count("*").alias("n"))


@query("j13_missing_anti", f"WITH {FILES} SELECT file_id, status FROM files WHERE source='src1' AND status<>'missing' AND NOT EXISTS (SELECT 1 FROM usage u WHERE 'g'||(u.n*2)=files.file_id)")
def j13(spark, d):
    present = usage_rows(spark, d).select(F.concat(F.lit("g"), (F.col("n") * 2).cast("string")).alias("file_id"))
    return incremental.missing_files(files(spark, d), present, "src1").select("file_id", "status")


@query("j13_mark_missing", f"WITH {FILES} SELECT status, count(*) AS n FROM (SELECT CASE WHEN source='src1' AND NOT EXISTS (SELECT 1 FROM usage u WHERE 'g'||(u.n*2)=files.file_id) THEN 'missing' ELSE status END AS status FROM files) GROUP BY 1")
def j13b(spark, d):
    present = usage_rows(spark, d).select(F.concat(F.lit("g"), (F.col("n") * 2).cast("string")).alias("file_id"))
    return incremental.mark_missing(files(spark, d), present, "src1").groupBy("status").agg(F.count("*").alias("n"))


@query("s05_changed_files", f"WITH {FILES}, m AS (SELECT file_id, size+(CASE WHEN n%10=2 THEN 1 ELSE 0 END) AS s, mtime_ms+(CASE WHEN n%10=3 THEN 2 ELSE 0 END) AS t FROM files WHERE status='complete' AND parser_version=9) SELECT file_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.file_id=f.file_id AND m.s=f.size AND abs(m.t-f.mtime_ms)<1)")
def s05(spark, d):
    f = files(spark, d)
    manifest = f.withColumns({"size": F.col("size") + F.when(F.col("n") % 10 == 2, 1).otherwise(0), "mtime_ms": F.col("mtime_ms") + F.when(F.col("n") % 10 == 3, 2).otherwise(0)})
    return incremental.changed_files(f.select("file_id", "size", "mtime_ms"), manifest.drop("n", "source"), 9).select("file_id")


@query("s22_checkpoint_lookup", f"WITH {FILES} SELECT file_id, status, size, parser_version FROM files WHERE file_id='g42'")
def s22(spark, d):
    return files(spark, d).where("file_id = 'g42'").select("file_id", "status", "size", "parser_version")


@query("o05_candidate_files", f"WITH {FILES} SELECT file_id, mtime_ms FROM files WHERE size>0 AND mtime_ms>=1706572800000-86400000 ORDER BY mtime_ms DESC, file_id LIMIT 96")
def o05(spark, d):
    f = files(spark, d).withColumn("path", F.col("file_id"))
    return incremental.candidate_files(f, 1_706_572_800_000, 96, 86_400_000).select("file_id", "mtime_ms")


@query("o08_rebuild_reasons", f"WITH {FILES} SELECT 'parser_version' AS reason WHERE EXISTS (SELECT 1 FROM files WHERE status<>'missing' AND parser_version<>9) UNION ALL SELECT 'negative_timestamp' WHERE EXISTS (SELECT 1 FROM files WHERE status<>'missing' AND n%50=3)")
def o08(spark, d):
    f = files(spark, d)
    raw = f.select("file_id", F.when(F.col("n") % 50 == 3, -1).otherwise(F.col("mtime_ms")).alias("ts_ms"))
    return incremental.rebuild_reasons(f, raw, 9)


FROZEN = 1_705_320_000_000


@query("t07_freeze_split", f"WITH {USAGE} SELECT ((SELECT max(ts_ms) FROM usage)-15*86400000)//1800000*1800000 AS frozen_ms, count(*) FILTER (WHERE ts_ms<((SELECT max(ts_ms) FROM usage)-15*86400000)//1800000*1800000) AS before, count(*) FILTER (WHERE ts_ms>=((SELECT max(ts_ms) FROM usage)-15*86400000)//1800000*1800000) AS after FROM usage")
def t07(spark, d):
    u = usage_rows(spark, d).select("ts_ms")
    line = u.agg(F.max("ts_ms").alias("m")).select(incremental.frozen_target(F.col("m"), 15).alias("frozen_ms"))
    return u.crossJoin(F.broadcast(line)).groupBy("frozen_ms").agg(F.count_if(F.col("ts_ms") < F.col("frozen_ms")).alias("before"), F.count_if(F.col("ts_ms") >= F.col("frozen_ms")).alias("after"))


@query("t08_late_drop", f"WITH {USAGE} SELECT (SELECT count(*) FROM usage WHERE ts_ms<{FROZEN}) AS late, count(*) AS kept, CAST(sum(total) AS BIGINT) AS total FROM usage WHERE ts_ms>={FROZEN}")
def t08(spark, d):
    kept, late = incremental.drop_late(usage_rows(spark, d), FROZEN)
    return kept.agg(F.count("*").alias("kept"), F.sum("total").alias("total")).crossJoin(late)


@query("j14_compact_anti", f"WITH {USAGE} SELECT source, session_hash, count(*) AS n FROM usage u WHERE EXISTS (SELECT 1 FROM usage v WHERE v.source=u.source AND v.session_hash=u.session_hash AND v.ts_ms>=1706486400000) GROUP BY 1,2")
def j14(spark, d):
    u = usage_rows(spark, d).select("source", "session_hash", "ts_ms")
    return incremental.compact_raw(u, u, 1_706_486_400_000)[1].groupBy("source", "session_hash").agg(F.count("*").alias("n"))


@query("m05_rekey_host", f"WITH {BUCKETS} SELECT 'host1' AS hostname, count(*) AS n, CAST(77 AS BIGINT) AS revision, CAST(0 AS BIGINT) AS synced_revision FROM buckets WHERE hostname='host0'")
def m05(spark, d):
    from tallyloom.plans.batch_queries import buckets

    b = buckets(spark, d).withColumns({"revision": F.lit(1).cast("long"), "synced_revision": F.lit(1).cast("long")})
    return incremental.rekey_host(b, "host0", "host1", 77).groupBy("hostname", "revision", "synced_revision").agg(F.count("*").alias("n"))


@query("m07_claim_unnamed", f"WITH {USAGE} SELECT 'host0' AS hostname, count(*) AS n FROM usage WHERE hostname='host0' OR hostname='host1'")
def m07(spark, d):
    u = usage_rows(spark, d).withColumn("hostname", F.when(F.col("hostname") == "host1", "").otherwise(F.col("hostname")))
    return incremental.claim_unnamed(u, "host0").groupBy("hostname").agg(F.count("*").alias("n"))


@query("s13_upsert_latest", f"WITH {USAGE}, a AS (SELECT n%900 AS id, n AS seq, total FROM usage) SELECT id, arg_max(total, seq) AS total FROM a GROUP BY 1")
def s13(spark, d):
    u = usage_rows(spark, d).select((F.col("n") % 900).alias("id"), F.col("n").alias("seq"), "total")
    return incremental.upsert_latest(u.where("seq % 2 = 0"), u.where("seq % 2 = 1")).select("id", "total")


@query("s14_snapshot_range", f"WITH {USAGE} SELECT n AS id, ts_ms FROM usage WHERE source='src2' AND ts_ms BETWEEN 1705000000000 AND 1705300000000")
def s14(spark, d):
    u = usage_rows(spark, d).select(F.col("n").alias("id"), "ts_ms", "source")
    return incremental.in_range(u, 1_705_300_000_000, 1_705_000_000_000, "src2").select("id", "ts_ms")


@query("o02_keep_newest", f"WITH {USAGE} SELECT n AS id, ts_ms FROM usage ORDER BY ts_ms DESC, id DESC LIMIT 500")
def o02(spark, d):
    return incremental.keep_newest(usage_rows(spark, d).select(F.col("n").alias("id"), "ts_ms"), 500)


@query("o03_delete_older", f"WITH {USAGE} SELECT count(*) AS n FROM usage WHERE ts_ms>={FROZEN}")
def o03(spark, d):
    return usage_rows(spark, d).where(F.col("ts_ms") >= FROZEN).agg(F.count("*").alias("n"))


@query("o04_history_slice", f"WITH {USAGE} SELECT n, ts_us AS at_us FROM usage WHERE ts_us BETWEEN (SELECT max(ts_us) FROM usage)-CAST(99999 AS BIGINT)*1000000 AND (SELECT max(ts_us) FROM usage) ORDER BY ts_us DESC LIMIT 100000")
def o04(spark, d):
    u = usage_rows(spark, d).select("n", F.col("ts_us").alias("at_us"))
    now = u.agg(F.max("at_us")).first()[0] or 0
    return incremental.history_slice(u, now, 100_000)


@query("o07_derived_reads", f"WITH {BUCKETS} SELECT bucket_start_ms, source, model, project, hostname, total FROM buckets WHERE hostname='host0'")
def o07(spark, d):
    from tallyloom.plans.batch_queries import buckets

    return buckets(spark, d).where("hostname = 'host0'").orderBy("bucket_start_ms", "source", "model", "project").select("bucket_start_ms", "source", "model", "project", "hostname", "total")


@query("a26_counts", f"WITH {USAGE} SELECT count(*) AS events, count(DISTINCT session_hash) AS sessions, count(*) FILTER (WHERE ts_ms<{FROZEN}) AS late FROM usage")
def a26(spark, d):
    return usage_rows(spark, d).agg(F.count("*").alias("events"), F.count_distinct("session_hash").alias("sessions"), F.count_if(F.col("ts_ms") < FROZEN).alias("late"))


@query("a27_diagnostics", f"WITH {FILES} SELECT source, count(*) AS files, count(*) FILTER (WHERE status='degraded') AS degraded, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1")
def a27(spark, d):
    return files(spark, d).groupBy("source").agg(F.count("*").alias("files"), F.count_if(F.col("status") == "degraded").alias("degraded"), F.sum("size").alias("bytes"))


# -- set operations ------------------------------------------------------------------------------


@query("u01_union_distinct", "SELECT user_id AS id FROM events UNION SELECT o_custkey FROM orders")
def u01(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("id")).union(table(spark, d, "orders").select("o_custkey")).distinct()


@query("u02_union_all", f"WITH {USAGE} SELECT origin, count(*) AS n FROM (SELECT 'low' AS origin FROM usage WHERE k<3 UNION ALL SELECT 'high' FROM usage WHERE k>90) GROUP BY 1")
def u02(spark, d):
    u = usage_rows(spark, d)
    return u.where("k < 3").select(F.lit("low").alias("origin")).unionByName(u.where("k > 90").select(F.lit("high").alias("origin"))).groupBy("origin").agg(F.count("*").alias("n"))


@query("u03_union_completed", f"WITH {USAGE} SELECT DISTINCT session_hash, 't'||(n//12) AS turn FROM usage WHERE k%4=1")
def u03(spark, d):
    return usage_rows(spark, d).where("k % 4 = 1").select("session_hash", F.concat(F.lit("t"), F.floor(F.col("n") / 12)).alias("turn")).distinct()


@query("u04_intersect", f"WITH {USAGE} SELECT session_hash FROM usage WHERE k=7 INTERSECT SELECT session_hash FROM usage WHERE k=70")
def u04(spark, d):
    u = usage_rows(spark, d)
    return u.where("k = 7").select("session_hash").intersect(u.where("k = 70").select("session_hash"))


@query("u05_except", f"WITH {USAGE} SELECT session_hash FROM usage WHERE k<50 EXCEPT SELECT session_hash FROM usage WHERE k=70")
def u05(spark, d):
    u = usage_rows(spark, d)
    return u.where("k < 50").select("session_hash").subtract(u.where("k = 70").select("session_hash"))

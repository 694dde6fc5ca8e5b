"""The driver's tables as the engine's inputs, in Spark and, for the oracle, in SQL.

``events`` stand in for usage rows (event type as model, user as session, value as tokens), ``conversations`` for session events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.exprs import micros, millis


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(prefix: str, c) -> F.Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    inp, k, n, user = F.col("inp"), F.col("k"), F.col("event_id"), F.col("user_id")
    e = e.withColumns({"inp": F.round(F.col("value") * 100).cast("long"), "k": F.get_json_object("props", "$.k").cast("long")})
    return e.select(
        text("e", n).alias("event_id"), text("src", user % 3).alias("source"), F.col("event_type").alias("model"), text("p", k % 10).alias("project"), millis("ts").alias("ts_ms"), micros("ts").alias("ts_us"),
        inp.alias("input"), (inp * 37 % 1000).alias("output"), (k * 3).alias("cached_input"), (k % 7).alias("cache_creation"), (n % 5 * k).alias("reasoning"),
        (inp + inp * 37 % 1000 + k * 3 + k % 7 + n % 5 * k).alias("total"), text("s", user).alias("session_hash"), text("f", n % 7).alias("file_id"), text("host", user % 2).alias("hostname"), k.alias("k"), n.alias("n"),
    )


USAGE = r"""usage AS (SELECT 'e'||event_id AS event_id, 'src'||(user_id%3) AS source, event_type AS model, 'p'||(k%10) AS project,
 (epoch_us(ts)+500)//1000 AS ts_ms, epoch_us(ts) AS ts_us, inp AS input, (inp*37)%1000 AS output, k*3 AS cached_input, k%7 AS cache_creation, (event_id%5)*k AS reasoning,
 inp+(inp*37)%1000+k*3+k%7+(event_id%5)*k AS total, 's'||user_id AS session_hash, 'f'||(event_id%7) AS file_id, 'host'||(user_id%2) AS hostname, k, event_id AS n
 FROM (SELECT *, CAST(round(value*100) AS BIGINT) AS inp, CAST(regexp_extract(props,'(\d+)',1) AS BIGINT) AS k FROM events))"""

SUMS = "CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cached_input) AS BIGINT) AS cached_input, CAST(sum(cache_creation) AS BIGINT) AS cache_creation, CAST(sum(reasoning) AS BIGINT) AS reasoning, CAST(sum(total) AS BIGINT) AS total"

BUCKETS = f"""{USAGE}, buckets AS (SELECT hostname, source, model, project, ts_ms//1800000*1800000 AS bucket_start_ms, {SUMS} FROM usage GROUP BY ALL)"""

# rank, pattern, USD per million: input, output, cache read, reasoning; made up for the event types
PRICE_ROWS = [(1, "c", 1.0, 2.0, 0.1, 0.5), (2, "click", 2.0, 4.0, 0.2, 1.0), (3, "err", 5.0, 9.0, 0.5, 2.0), (4, "ror", 7.0, 8.0, 0.4, 1.5), (5, "VIEW", 0.5, 1.5, 0.05, 0.0), (6, "", 99.0, 99.0, 99.0, 99.0), (7, "gnu", 1.1, 2.2, 0.3, 0.4)]
PRICE_SCHEMA = "rank int, pattern string, input_price double, output_price double, cache_price double, reasoning_price double"
PRICES = "prices AS (SELECT * FROM (VALUES " + ", ".join(f"({r[0]}, '{r[1]}', {', '.join(f'CAST({x} AS DOUBLE)' for x in r[2:])})" for r in PRICE_ROWS) + ") AS v(rank, pattern, input_price, output_price, cache_price, reasoning_price))"
PRICED = f"""{PRICES}, matched AS (SELECT model, input_price, output_price, cache_price, reasoning_price, row_number() OVER (PARTITION BY model ORDER BY length(pattern) DESC, rank) AS rn
 FROM (SELECT DISTINCT model FROM buckets) JOIN prices ON pattern <> '' AND contains(lower(model), lower(pattern))),
 costed AS (SELECT b.*, (input*coalesce(input_price,3.0)+output*coalesce(output_price,15.0)+cached_input*coalesce(cache_price,0.3)+reasoning*coalesce(reasoning_price,0.0))/1000000 AS cost
 FROM buckets b LEFT JOIN (SELECT * FROM matched WHERE rn=1) m USING (model))"""


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICE_ROWS, PRICE_SCHEMA)


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as minutes; system messages as synthetic users."""
    c = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "system", "synthetic_user").otherwise(F.col("role"))
    at = F.col("turn") * 60_000 + F.col("conv_id") * 7_000
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("event_id"), F.lit("talk").alias("source"), F.col("conv_id").cast("string").alias("session_hash"), role.alias("role"), at.alias("ts_ms"), F.lit("f").alias("file_id"))


SESSIONS = """se AS (SELECT conv_id||':'||turn AS event_id, 'talk' AS source, CAST(conv_id AS VARCHAR) AS session_hash, CASE role WHEN 'system' THEN 'synthetic_user' ELSE role END AS role,
 turn*60000+conv_id*7000 AS ts_ms, 'f' AS file_id FROM conversations)"""
SEGMENTS = SESSIONS + """, marked AS (SELECT *, sum(CASE WHEN role IN ('user','synthetic_user') THEN 1 ELSE 0 END) OVER (PARTITION BY source, session_hash
 ORDER BY ts_ms, CASE WHEN role IN ('user','synthetic_user') THEN 0 ELSE 1 END, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM se),
 spans AS (SELECT source, session_hash, segment, max(ts_ms)-min(ts_ms) AS ms FROM marked WHERE segment>0 AND role NOT IN ('user','synthetic_user') GROUP BY ALL),
 active AS (SELECT source, session_hash, CAST(round(sum(ms)/1000.0) AS BIGINT) AS active_seconds FROM spans GROUP BY ALL)"""


def raw_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third usage row twice more: an older copy in a missing file, a copy with other counts in the same tier."""
    u = usage(spark, sf_dir).withColumns({"inherited": F.col("n") % 4 == 0, "has_total_snapshot": F.col("n") % 3 == 0, "merge_strategy": F.lit("overwrite")})
    u = u.withColumns({"tier": F.lit(2), "lineage_fingerprint": F.when(F.col("n") % 5 == 0, text("l", F.floor(F.col("n") / 20))).otherwise(""), "dedup_key": F.when(F.col("n") % 6 == 0, text("d", F.floor(F.col("n") / 30))).otherwise("")})
    older = u.where("n % 3 = 0").withColumns({"tier": F.lit(1), "input": F.col("input") + 1000, "file_id": F.lit("gone")})
    other = u.where("n % 3 = 0").withColumns({"model": F.when(F.col("n") % 2 == 0, "unknown").otherwise(F.col("model")), "output": F.col("output") + 5, "file_id": F.lit("a_copy"), "total": F.col("total") + 5})
    return u.unionByName(older).unionByName(other)


RAW = f"""{USAGE}, base AS (SELECT *, n%4=0 AS inherited, n%3=0 AS has_total_snapshot, 2 AS tier, CASE WHEN n%5=0 THEN 'l'||(n//20) ELSE '' END AS lineage_fingerprint,
 CASE WHEN n%6=0 THEN 'd'||(n//30) ELSE '' END AS dedup_key FROM usage),
 raw AS (SELECT * FROM base UNION ALL BY NAME SELECT * REPLACE (1 AS tier, input+1000 AS input, 'gone' AS file_id) FROM base WHERE n%3=0
 UNION ALL BY NAME SELECT * REPLACE (CASE WHEN n%2=0 THEN 'unknown' ELSE model END AS model, output+5 AS output, 'a_copy' AS file_id, total+5 AS total) FROM base WHERE n%3=0)"""

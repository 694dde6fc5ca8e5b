"""The ledger's life: files replaced, finalize with a freeze, partition drop, reporting and old schemas, over all usage rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.usage import bucket_tokens
from tallyloom.plans.catalogue import query
from tallyloom.plans.tables import SUMS, USAGE, session_events
from tallyloom.plans.tables import usage as usage_rows
from tallyloom.schemas import COUNTS, FREEZE_DAYS
from tallyloom.sources.ledger import DAY_MS, Ledger, Migrations, finalize, report
from tallyloom.sources.shared import shared_dir

FROZEN = 1_706_486_400_000
NOW = FROZEN + FREEZE_DAYS * DAY_MS
KEYS, VALUES = ["hostname", "source", "model", "project", "bucket_start_ms"], [*COUNTS, "total"]
PAGE, PAGES = 500, 4
GROUPS = f"hostname, source, model, project, ts_ms//1800000*1800000 AS bucket_start_ms, {SUMS}"


def derive(rows: DataFrame) -> DataFrame:
    return bucket_tokens(rows, KEYS[:-1])


def files_of(rows: DataFrame, status: str = "complete") -> DataFrame:
    return rows.select("file_id", "source").groupBy("file_id").agg(F.min("source").alias("source")).withColumns({"offset": F.lit(1).cast("long"), "size": F.lit(1).cast("long"), "status": F.lit(status)})


def fresh(spark, migrations: Migrations | None = None) -> Ledger:
    return Ledger(spark, shared_dir(spark, "usage"), buckets=8, migrations=migrations)


def recorded(spark, d) -> tuple[Ledger, DataFrame]:
    """A ledger with all usage rows as events."""
    ledger, rows = fresh(spark), usage_rows(spark, d)
    ledger.record(files_of(rows), events=rows)
    return ledger, rows


@query("s15_replace_by_file", f"""WITH {USAGE}, live AS (SELECT * FROM usage WHERE file_id NOT IN ('f1','f2','f3') OR (file_id='f1' AND n%2=0) UNION ALL SELECT * REPLACE (total+1 AS total) FROM usage WHERE file_id='f2')
 SELECT file_id, count(*) AS n, CAST(sum(total) AS BIGINT) AS total, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM live GROUP BY 1""")  # fmt: skip
def s15(spark, d):
    """f1 loses half of its rows, f2's change, f3 is emptied; all other files stay."""
    ledger, rows = recorded(spark, d)
    new = rows.where("(file_id = 'f1' and n % 2 = 0) or file_id = 'f2'").withColumn("total", F.col("total") + (F.col("file_id") == "f2").cast("long"))
    ledger.record(files_of(rows.where("file_id in ('f1', 'f2', 'f3')")), events=new)
    return ledger.read("events").groupBy("file_id").agg(F.count("*").alias("n"), F.sum("total").alias("total"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@query("m04_finalize", f"""WITH {USAGE}, again AS (SELECT * REPLACE (input+CASE WHEN file_id='f1' THEN 1 ELSE 0 END AS input, total+CASE WHEN file_id='f1' THEN 1 ELSE 0 END AS total) FROM usage WHERE ts_ms>={FROZEN}),
 b1 AS (SELECT {GROUPS} FROM usage GROUP BY ALL), b2 AS (SELECT {GROUPS} FROM again GROUP BY ALL)
 SELECT b1.*, 1 AS revision, 0 AS synced_revision FROM b1 WHERE bucket_start_ms<{FROZEN}
 UNION ALL SELECT b2.*, CASE WHEN b1.total=b2.total THEN 1 ELSE 2 END, 0 FROM b2 JOIN b1 USING (hostname, source, model, project, bucket_start_ms)""")  # fmt: skip
def m04(spark, d):
    """Two rounds with a freeze between them: file f1 comes again with other counts, which counts behind the line only."""
    ledger, rows = recorded(spark, d)
    finalize(ledger, derive, KEYS, VALUES, "host0", NOW, compact=True)
    f1 = rows.where("file_id = 'f1'").withColumns({"input": F.col("input") + 1, "total": F.col("total") + 1})
    ledger.record(files_of(f1), events=f1)
    finalize(ledger, derive, KEYS, VALUES, "host0", NOW, compact=True)
    return ledger.derived().select(*KEYS, *VALUES, "revision", "synced_revision")


@query("t09_partition_drop", f"""WITH {USAGE} SELECT 'events' AS kind, source, count(*) AS n FROM usage WHERE ts_ms>={FROZEN} GROUP BY 2
 UNION ALL SELECT 'session_events', source, count(*) FROM usage WHERE (source, session_hash) IN (SELECT source, session_hash FROM usage WHERE ts_ms>={FROZEN}) GROUP BY 2""")  # fmt: skip
def t09(spark, d):
    ledger, rows = fresh(spark), usage_rows(spark, d)
    ledger.record(files_of(rows), events=rows, session_events=rows.select("event_id", "source", "session_hash", "ts_ms", "file_id"))
    finalize(ledger, derive, KEYS, VALUES, "host0", NOW, compact=True)
    counts = [ledger.read(t).groupBy("source").agg(F.count("*").alias("n")).select(F.lit(t).alias("kind"), "source", "n") for t in ("events", "session_events")]
    return counts[0].unionByName(counts[1])


@query("m12_report_loop", f"""WITH {USAGE}, b AS (SELECT {GROUPS} FROM usage GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY bucket_start_ms, source, model, project, hostname) AS n FROM b)
 SELECT hostname, source, model, project, bucket_start_ms, CAST(1 AS BIGINT) AS revision, CAST(CASE WHEN n<={PAGE * PAGES} THEN 1 ELSE 0 END AS BIGINT) AS synced_revision FROM o""")  # fmt: skip
def m12(spark, d):
    """The receiver confirms four pages, and of the next one a row too few: the loop stops there."""
    ledger, _ = recorded(spark, d)
    finalize(ledger, derive, KEYS, VALUES, "host0", NOW)
    pages: list[int] = []

    def send(rows: list[dict]) -> int:
        pages.append(len(rows))
        return len(rows) - (len(pages) > PAGES)

    report(ledger, send, ["bucket_start_ms", "source", "model", "project", "hostname"], "host0", PAGE)
    return ledger.derived().select(*KEYS, "revision", "synced_revision")


@query("m10_upcast_read", f"""WITH {USAGE} SELECT file_id, CASE WHEN file_id IN ('f0','f1') THEN 'unknown' ELSE hostname END AS hostname, count(*) AS n, CAST(sum(reasoning) AS BIGINT) AS reasoning, CAST(sum(total) AS BIGINT) AS total
 FROM usage GROUP BY 1,2""")  # fmt: skip
def m10(spark, d):
    """Files f0 and f1 were written before rows had a host, f2 and f3 while thinking was a text column; all are read as the newest."""
    code = [Migrations() for _ in range(3)]
    for m in code[1:]:
        m.step("events", 1)(lambda rows: rows.withColumn("hostname", F.lit("unknown")))
    code[2].step("events", 2)(lambda rows: rows.withColumn("reasoning", F.col("reasoning").cast("long")))
    rows, ledger = usage_rows(spark, d), fresh(spark)
    texts = rows.withColumn("reasoning", F.col("reasoning").cast("string"))
    for m, part in zip(code, (texts.where("file_id in ('f0', 'f1')").drop("hostname"), texts.where("file_id in ('f2', 'f3')"), rows.where("file_id not in ('f0', 'f1', 'f2', 'f3')"))):
        ledger.migrations = m
        ledger.record(files_of(part), events=part)
    return ledger.read("events").groupBy("file_id", "hostname").agg(F.count("*").alias("n"), F.sum("reasoning").alias("reasoning"), F.sum("total").alias("total"))


@query("x_session_rows_by_file", """SELECT CAST(conv_id%8 AS VARCHAR) AS file_id, count(*) AS n FROM conversations WHERE conv_id%8 IN (2,5) GROUP BY 1""")
def rows_by_file(spark, d):
    """Two files' rows, read from their buckets alone."""
    rows = session_events(spark, d).withColumn("file_id", F.pmod(F.col("session_hash").cast("long"), F.lit(8)).cast("string"))
    ledger = fresh(spark)
    ledger.record(files_of(rows), session_events=rows)
    return ledger.read("session_events", ["2", "5"]).groupBy("file_id").agg(F.count("*").alias("n"))

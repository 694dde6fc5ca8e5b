"""Sessions: user turns anchor segments, assistants' records extend them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION = ["source", "session_hash"]


def is_user() -> Column:
    return F.col("role").isin("user", "synthetic_user")


def role_rank() -> Column:
    """Users come before assistants at the same instant."""
    return F.when(is_user(), 0).otherwise(1)


def segments(events: DataFrame) -> DataFrame:
    """``(session, segment, first_ms, last_ms)`` of the assistants' records after each user turn; what comes before the first turn is no segment."""
    w = Window.partitionBy(*SESSION).orderBy("ts_ms", role_rank(), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = events.withColumn("segment", F.sum(is_user().cast("int")).over(w))
    return marked.where((F.col("segment") > 0) & ~is_user()).groupBy(*SESSION, "segment").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def active_seconds(events: DataFrame) -> DataFrame:
    spans = segments(events).groupBy(*SESSION).agg(F.sum(F.col("last_ms") - F.col("first_ms")).alias("ms"))
    return spans.select(*SESSION, F.round(F.col("ms") / 1000).cast("long").alias("active_seconds"))


def hour_histogram(events: DataFrame) -> DataFrame:
    """24 counts of records by UTC hour."""
    hour = F.pmod(F.floor(F.col("ts_ms") / 3_600_000), F.lit(24))
    return events.groupBy(*SESSION).agg(F.array(*[F.count_if(hour == h) for h in range(24)]).alias("hour_histogram"))


def session_aggregate(events: DataFrame) -> DataFrame:
    """One row per session of deduplicated events: times, active seconds, message counts and the hour histogram."""
    hour = F.pmod(F.floor(F.col("ts_ms") / 3_600_000), F.lit(24))
    base = events.groupBy(*SESSION).agg(
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.count("*").alias("message_count"),
        F.count_if(F.col("role") == "user").alias("user_message_count"),
        F.count_if(F.col("role") == "assistant").alias("assistant_events"),
        F.array(*[F.count_if(hour == h) for h in range(24)]).alias("hour_histogram"),
    )
    return base.join(active_seconds(events), SESSION, "left").withColumn("active_seconds", F.coalesce("active_seconds", F.lit(0).cast("long")))


def latest_project(events: DataFrame) -> DataFrame:
    """Project of each session's last row with one; of rows at the same time the first."""
    order = F.struct(-F.col("ts_ms"), F.col("event_id"), F.col("file_id"))
    return events.where("project <> ''").groupBy(*SESSION).agg(F.min_by("project", order).alias("project"))


def session_skills(events: DataFrame) -> DataFrame:
    """Sorted skills of rows that aren't inherited."""
    return events.where(~F.col("inherited")).select(*SESSION, F.explode(F.map_keys("skill_counts")).alias("s")).groupBy(*SESSION).agg(F.array_sort(F.collect_set("s")).alias("skills"))


def sessions_with_dims(sessions: DataFrame, projects: DataFrame, skills: DataFrame) -> DataFrame:
    out = sessions.join(projects, SESSION, "left").join(skills, SESSION, "left")
    return out.withColumns({"project": F.coalesce("project", F.lit("unknown")), "skills": F.coalesce("skills", F.array().cast("array<string>"))})


def normalise_session(rows: DataFrame) -> DataFrame:
    """Counts not below zero, the histogram padded or cut to 24."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.greatest(F.coalesce(F.get("hour_histogram", i), F.lit(0)), F.lit(0)).cast("long"))
    numbers = [c for c in ("active_seconds", "message_count", "user_message_count", "assistant_events") if c in rows.columns]
    return rows.withColumns({**{c: F.greatest(c, F.lit(0)) for c in numbers}, "hour_histogram": slots})

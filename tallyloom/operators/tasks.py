"""Tasks and statuses: what is running, what has ended, what a source is doing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE_SECONDS = 300
LIFECYCLE = ["task_started", "task_complete", "turn_aborted"]


def last_lifecycle(lines: DataFrame) -> DataFrame:
    """``(file_id, lifecycle)``: the last start, end or abort in each file."""
    return lines.where(F.col("event").isin(*LIFECYCLE)).groupBy("file_id").agg(F.max_by("event", "line_no").alias("lifecycle"))


def completed_tasks(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct (session, turn) that ended; a turn without an id counts by its line."""
    turn = F.coalesce("turn_id", F.concat(F.lit("line:"), F.col("line_no").cast("string")))
    return lines.where("event = 'task_complete'").groupBy(*(keys or [])).agg(F.count_distinct("session", turn).alias("completed"))


def sessions_by_category(sessions: DataFrame, now_us: Column | int, seconds: int = ACTIVE_SECONDS) -> DataFrame:
    """``(category, total, active)``: distinct sessions, and those with activity in the last minutes whatever their lifecycle says."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    recent = F.col("activity_us") >= now - seconds * 1_000_000
    return sessions.groupBy("category").agg(F.count_distinct("session").alias("total"), F.count_distinct(F.when(recent, F.col("session"))).alias("active"))


def sum_available(*cs: Column | str) -> Column:
    """The sum, or null if any part is unknown: missing isn't zero."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cs]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def active_desktop(messages: DataFrame, now_us: Column | int, seconds: int = ACTIVE_SECONDS) -> DataFrame:
    """Sessions whose last message is the user's, or an assistant's that hasn't ended its turn, not older than ``seconds``."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    last = messages.groupBy("session").agg(F.max_by(F.struct("role", "stop_reason", "at_us"), "line_no").alias("m"))
    open_ = (F.col("m.role") == "user") | F.col("m.stop_reason").isNull() | (F.col("m.stop_reason") == "tool_use")
    return last.where(open_ & (now - F.col("m.at_us") <= seconds * 1_000_000)).select("session", "m.role", "m.at_us")


def live_registered(pids: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered sessions of live processes: the pid in the file's name, in the file and in the process table agree."""
    return registry.where(F.col("file_pid") == F.col("pid")).join(pids.select("pid").distinct(), "pid", "left_semi")


def source_status(alive: Column, open_turns: Column, scan_failed: Column) -> Column:
    """degraded if a scan failed, else notRunning, generating or idle."""
    return F.when(scan_failed, "degraded").when(~alive, "notRunning").when(open_turns > 0, "generating").otherwise("idle")


def source_rollup(files: DataFrame) -> DataFrame:
    """Per source: ended tasks and open turns over its files; the quality is unavailable if nothing could be parsed, else partial."""
    return files.groupBy("source").agg(
        F.sum("completed").alias("completed"), F.count_if(F.col("lifecycle") == "task_started").alias("open_turns"),
        F.when(F.count_if("parsed") == 0, "unavailable").otherwise("partial").alias("quality"),
    )


def rank_categories(rows: DataFrame, most: int = 4) -> DataFrame:
    """Present categories with something active: most active first, then most in all, then the fixed place."""
    out = rows.where(F.col("present") & (F.col("active") > 0))
    return out.orderBy(F.desc(F.coalesce("active", F.lit(-1))), F.desc(F.coalesce("total", F.lit(-1))), "place").limit(most)


def normalise_snapshot(rows: DataFrame) -> DataFrame:
    """Counts of an unavailable snapshot are null; those of a partial one are lower bounds, not below zero."""
    gone = F.col("quality") == "unavailable"
    clean = {c: F.when(gone, None).otherwise(F.greatest(c, F.lit(0))) for c in ("total", "active") if c in rows.columns}
    return rows.withColumns({**clean, "lower_bound": F.col("quality") == "partial"})


def normalise_sample(rows: DataFrame) -> DataFrame:
    """live has figures, zero has zeros, every other state has nulls."""
    fix = lambda c: F.when(F.col("state") == "live", F.col(c)).when(F.col("state") == "zero", 0.0)
    return rows.withColumns({c: fix(c) for c in ("tps", "tokens_180", "tokens_5", "tokens_1") if c in rows.columns})

"""What a live log line says, whatever its dialect: time, model, tokens, message, session kind.

Built from the line's text (``raw``) by path expressions; nothing reaches Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.exprs import is_unknown, parse_time
from tallyloom.operators.rollout import js, text
from tallyloom.schemas import FUTURE_SLACK_SECONDS, MAX_LONG

# Fields that hold what is looked for, in the order in which they are tried.
TIME_FIELDS = ["timestamp", "ts", "created_at", "createdAt"]
MODEL_FIELDS = ["model", "payload.model", "payload.thread_settings.model", "message.model", "payload.message.model"]
OUTPUT_NAMES = ["output_tokens", "outputTokens", "completion_tokens", "completionTokens"]
TOTAL_NAMES = ["total_output_tokens", "totalOutputTokens"]
USAGE_PATHS = ["payload.info.last_token_usage.", "payload.info.total_token_usage.", "payload.usage.", "usage.", "message.usage.", ""]


def whole(c: Column) -> Column:
    """A number or numeric text as a long that doesn't pass its ends and isn't below zero; booleans and other values are null."""
    d = F.when(c.rlike(r"^\s*-?\d{1,30}(\.\d+)?\s*$"), F.trim(c).cast("decimal(38,4)"))
    held = F.greatest(F.least(F.floor(d), F.lit(MAX_LONG).cast("decimal(38,0)")), F.lit(0)).cast("long")
    return F.when(d.isNotNull(), held)


def first_of(*cs: Column) -> Column:
    return F.coalesce(*cs)


def signal_time(now: Column) -> Column:
    """Time of the line, else now; a time more than a few seconds ahead counts as now."""
    t = first_of(*[parse_time(js(f)) for f in TIME_FIELDS], now)
    return F.when(F.unix_micros(t) > F.unix_micros(now) + FUTURE_SLACK_SECONDS * 1_000_000, now).otherwise(t)


def model_name() -> Column:
    return first_of(*[text(f) for f in MODEL_FIELDS])


def context_model() -> Column:
    """The model that a turn's context names; no other line decides it."""
    return F.when(js("type") == "turn_context", text("payload.model"))


def anywhere(names: list[str]) -> Column:
    """The first field of these names at any depth."""
    return F.regexp_extract("raw", rf"\"(?:{'|'.join(names)})\"\s*:\s*\"?(\d+(?:\.\d+)?)", 1)


def output_tokens() -> Column:
    """Output tokens at the known places, else wherever the line has them."""
    return first_of(*[whole(js(f"{p}{n}")) for p in USAGE_PATHS for n in OUTPUT_NAMES], whole(anywhere(OUTPUT_NAMES)))


def cumulative_tokens() -> Column:
    """The running total of output tokens, by its own name or in the total usage."""
    return first_of(whole(anywhere(TOTAL_NAMES)), *[whole(js(f"payload.info.total_token_usage.{n}")) for n in OUTPUT_NAMES])


def message_identity() -> Column:
    """Session and message id, or null where a line is no message."""
    mid = F.when(js("message").isNotNull(), first_of(text("message.id"), text("uuid")))
    return F.when(mid.isNotNull(), F.concat(first_of(text("sessionId"), text("session_id"), F.lit("")), F.lit("\0"), mid))


def top_level() -> Column:
    """A user's thread, or a session whose source is a plain name and not the record of a spawned agent."""
    source = js("payload.source")
    return (js("type") == "session_meta") & (F.coalesce(js("payload.thread_source") == "user", F.lit(False)) | F.coalesce((source != "") & ~source.startswith("{"), F.lit(False)))


def signals(lines: DataFrame, now: Column) -> DataFrame:
    """Lines with all of these."""
    return lines.withColumns({"at": signal_time(now), "model": model_name(), "tokens": output_tokens(), "total": cumulative_tokens(), "message": message_identity()})


def latest_model(lines: DataFrame) -> DataFrame:
    """``(file_id, model)``: the last model that a turn's context names, else the last that any line does."""
    ctx, some = context_model(), model_name()
    named = lambda c: F.max_by(c, F.when(c.isNotNull() & ~is_unknown(c), F.col("line_no")))
    return lines.groupBy("file_id").agg(F.coalesce(named(ctx), named(some)).alias("model"))

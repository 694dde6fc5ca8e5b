"""Rollout files: cumulative token counters per file, with a lineage to a parent file.

Lines are ``(file_id, source, line_no, raw)``. A file is a session log and small; windows per file are the order that the format needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.exprs import hash_id, is_unknown, known, last_component, once, parse_time, rollout_counts
from tallyloom.schemas import COUNTS, UNKNOWN

PARTS = [*COUNTS, "total"]


def js(path: str, column: str = "raw") -> Column:
    return F.get_json_object(column, f"$.{path}")


def text(path: str) -> Column:
    return F.nullif(F.trim(js(path)), F.lit(""))


def number(path: str) -> Column:
    return as_number(js(path))


def as_number(v: Column) -> Column:
    return F.when(v == "true", 1).when(v.rlike(r"^-?\d{1,18}(\.\d+)?$"), v.cast("decimal(30,6)").cast("long")).otherwise(0).cast("long")


def parsed(lines: DataFrame) -> DataFrame:
    """Lines that are JSON objects, with type, payload type and time."""
    ok = lines.where(F.try_parse_json("raw").isNotNull() & F.trim("raw").startswith("{"))
    ok = ok.select(*lines.columns, F.json_tuple("raw", "type", "timestamp").alias("type", "ts_ms"))  # one reading of the line; no key comes twice in what parses
    return once(ok, {"ptype": js("payload.type"), "ts_ms": F.unix_millis(parse_time("ts_ms"))})


def first_lines_fields() -> Column:
    """Keys, project and parent that a session_meta line gives its file."""
    parents = F.array_distinct(F.array_compact(F.array(text("payload.parent_thread_id"), text("payload.forked_from_id"), text("payload.source.subagent.thread_spawn.parent_thread_id"))))
    short = lambda c: F.coalesce(hash_id(c, length=16), F.lit(""))
    empty = lambda c: F.when(c.isNull(), "").otherwise(short(c))
    return F.struct(
        empty(text("payload.id")).alias("rollout_key"), text("payload.session_id").alias("session_id"), F.coalesce(last_component(text("payload.cwd")), F.lit(UNKNOWN)).alias("project"),
        F.when(F.size(parents) == 1, short(parents[0])).otherwise("").alias("parent_rollout_key"), (F.size(parents) > 0).alias("has_parent"), (F.size(parents) > 1).alias("parent_conflict"),
    )


def metadata(rows: DataFrame) -> DataFrame:
    """One row per file that has a session_meta: keys, project and parent, all from the first one."""
    return rows.where("type = 'session_meta'").groupBy("file_id").agg(F.min_by(first_lines_fields(), "line_no").alias("m")).select("file_id", "m.*")


def session_hash() -> Column:
    return F.when(F.col("rollout_key") != "", F.col("rollout_key")).otherwise(F.left("file_id", F.lit(16)))


def with_metadata(rows: DataFrame) -> DataFrame:
    out = rows.join(metadata(rows), "file_id", "left")
    fill = {"rollout_key": "", "project": UNKNOWN, "parent_rollout_key": "", "has_parent": False, "parent_conflict": False}
    out = out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})
    return out.withColumn("session_hash", session_hash())


FIELDS = ["input_tokens", "cached_input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]


def complete_snapshot(path: str, get: Callable[[str], Column] = js) -> Column:
    """Input, output and total are whole numbers not below zero, and the first two add up to the third."""
    whole = lambda c: F.when(get(f"{path}.{c}").rlike(r"^\d{1,18}(\.0+)?$"), get(f"{path}.{c}").cast("decimal(30,1)"))
    return F.coalesce(whole("input_tokens") + whole("output_tokens") == whole("total_tokens"), F.lit(False))


def session_events(rows: DataFrame) -> DataFrame:
    """Every line with a time, once: session_meta anchors a synthetic user turn, turn_context a user turn, all else is the assistant's."""
    role = F.when(F.col("type") == "session_meta", "synthetic_user").when(F.col("type") == "turn_context", "user").otherwise("assistant")
    ident = (
        F.when(F.col("type") == "session_meta", F.concat(F.lit("session-meta:"), F.coalesce(text("payload.id"), text("payload.session_id"))))
        .when(F.col("type") == "turn_context", F.concat(F.lit("turn-context:"), F.coalesce(text("payload.turn_id"), text("payload.id"))))
        .when((F.col("type") == "response_item") & (F.col("ptype") == "message"), F.concat(F.lit("message:"), F.coalesce(text("payload.id"), text("payload.message.id"))))
        .when(F.col("type") == "event_msg", F.concat_ws(":", F.lit("event"), "ptype", js("payload")))
    )
    timed = with_metadata(rows).where(F.col("ts_ms").isNotNull()).withColumn("role", role)
    eid = hash_id("source", F.lit("session-event"), "session_hash", "role", F.coalesce(ident, F.concat(F.lit("json:"), F.col("raw"))), F.concat(F.lit("occurrence:"), F.col("line_no").cast("string")))
    return timed.select(eid.alias("event_id"), "source", "session_hash", "role", "ts_ms", "file_id", F.lit("").alias("hostname"))


def usage_events(rows: DataFrame) -> DataFrame:
    """Token events of parsed rollout lines, in the shape of ``usage_events`` without the count-only ones."""
    order = Window.partitionBy("file_id").orderBy("line_no")
    so_far, before, whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ctx = F.col("type") == "turn_context"
    r = once(with_metadata(rows), {"ctx_model": F.when(ctx, text("payload.model"))})
    model = F.col("ctx_model")
    r = r.withColumns({"turn_model": F.coalesce(F.last(model, ignorenulls=True).over(so_far), F.lit(UNKNOWN)), "final_model": F.coalesce(F.last(model, ignorenulls=True).over(whole), F.lit(UNKNOWN)), "seen_ctx": F.coalesce(F.max(ctx.cast("int")).over(so_far), F.lit(0)) == 1})
    last_path, total_path = "payload.info.last_token_usage", "payload.info.total_token_usage"
    there = lambda p: ~F.coalesce(js(p), F.lit("null")).isin("{}", "null")
    t = once(r.where((F.col("type") == "event_msg") & (F.col("ptype") == "token_count")), {"has_last": there(last_path), "has_total": there(total_path)}).where("has_last or has_total")
    # each field is read once, as text, and made a number once
    at = lambda p: F.col(f"`{p}`")
    t = once(t, {"info_model": text("payload.info.model"), **{f"{p}.{c}": js(f"{p}.{c}") for p in (last_path, total_path) for c in FIELDS}})
    t = once(t, {"snapshot": F.col("has_total") & complete_snapshot(total_path, at), **{f"{p}.{c}": as_number(at(f"{p}.{c}")) for p in (last_path, total_path) for c in FIELDS}})
    counts = lambda p: rollout_counts(*[at(f"{p}.{c}") for c in FIELDS])
    t = once(t, {"lastc": F.when(F.col("has_last"), counts(last_path)).otherwise(counts(total_path)), "totalc": F.when(F.col("has_total"), counts(total_path))})
    # the running baseline: the latest total; a row that has none leaves it as it is
    t = t.withColumn("prev", F.last("totalc", ignorenulls=True).over(before))
    total = lambda s: F.greatest(F.col(f"{s}.total"), sum((F.col(f"{s}.{c}") for c in COUNTS[1:]), F.col(f"{s}.{COUNTS[0]}")))
    parts_sum = lambda s: sum((F.col(f"{s}.{c}") for c in COUNTS[1:]), F.col(f"{s}.{COUNTS[0]}"))
    fell = (total("lastc") < total("prev")) | (parts_sum("lastc") < parts_sum("prev"))
    grown = F.struct(*[F.greatest(F.col(f"lastc.{c}") - F.col(f"prev.{c}"), F.lit(0)).alias(c) for c in COUNTS], F.greatest(total("lastc") - total("prev"), F.lit(0)).alias("total"))
    t = t.withColumn("c", F.when(F.col("has_last") | F.col("prev").isNull() | fell, F.col("lastc")).otherwise(grown))
    t = t.withColumn("all", total("c")).where((F.col("all") > 0) & F.col("ts_ms").isNotNull())
    t = t.withColumns({"emitted": F.coalesce("info_model", "turn_model"), "inherited": F.col("has_parent") & ~F.col("seen_ctx")})
    ident = lambda s: F.concat_ws("|", *[F.col(f"{s}.{c}").cast("string") for c in PARTS])
    root = F.when(F.col("inherited"), F.col("parent_rollout_key")).otherwise(F.col("rollout_key"))
    proven = F.col("snapshot") & ~F.col("parent_conflict") & (root != "")
    scope = F.when(F.col("rollout_key") != "", F.concat(F.lit("rollout:"), "rollout_key")).when(F.col("session_id").isNotNull(), F.concat(F.lit("session:"), hash_id("session_id", length=16))).otherwise("missing-rollout")
    raw_total = F.concat_ws("|", *[at(f"{total_path}.{c}").cast("string") for c in ("input_tokens", "output_tokens", "cached_input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "reasoning_output_tokens", "total_tokens")])
    t = once(t, {
        "lineage_fingerprint": F.when(proven, hash_id(F.lit("total"), root, F.lit("last"), ident("lastc"), F.lit("snapshot"), ident("totalc"))).otherwise(""),
        "base_id": hash_id(F.lit("codex-token"), scope, "emitted", ident("lastc"), F.when(F.col("snapshot"), F.concat(F.lit("complete|"), ident("totalc"))).otherwise("incomplete")),
        "dedup_key": F.when(F.col("snapshot"), F.concat(F.lit("codex:"), hash_id(F.lit("codex-token"), "emitted", ident("lastc"), raw_total, length=32))).otherwise(""),
    })
    nth = F.row_number().over(Window.partitionBy("file_id", "base_id").orderBy("line_no")) - 1
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    backfill = ~F.col("has_parent") & is_unknown("emitted") & ~is_unknown("final_model")
    return t.select(
        F.when(nth == 0, F.col("base_id")).otherwise(F.concat("base_id", F.lit("#"), nth.cast("string"))).alias("event_id"), "source", F.when(backfill, F.col("final_model")).otherwise(known("emitted")).alias("model"), "project", "ts_ms",
        *[F.col(f"c.{c}").alias(c) for c in COUNTS], F.col("all").alias("total"), "session_hash", "file_id", "rollout_key", "parent_rollout_key", "inherited", F.col("snapshot").alias("has_total_snapshot"), "lineage_fingerprint", "dedup_key",
        F.lit("overwrite").alias("merge_strategy"), none.alias("skill_counts"), none.alias("mcp_counts"), F.lit("").alias("hostname"),
    )


def diagnostics(rows: DataFrame) -> DataFrame:
    """Token lines without a usable time, and files whose parents contradict each other."""
    bad = rows.where((F.col("type") == "event_msg") & (F.col("ptype") == "token_count") & F.col("ts_ms").isNull())
    lost = bad.select("file_id", F.concat(F.lit("line "), (F.col("line_no") + 1).cast("string"), F.lit(": invalid timestamp (usage skipped)")).alias("message"))
    odd = metadata(rows).where("parent_conflict").select("file_id", F.lit("session_meta: conflicting parent references; lineage replay disabled").alias("message"))
    return lost.unionByName(odd)

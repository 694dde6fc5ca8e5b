"""Transcript files: one API answer spread over several lines that repeat its usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.exprs import hash_id, is_unknown, known, last_component, mcp_server, once, reasoning_split, total_of
from tallyloom.operators.dedup import map_max
from tallyloom.operators.rollout import as_number, js, parsed, text
from tallyloom.schemas import COUNTS, UNKNOWN

BLOCKS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean>>"
USAGE = {"input": "input_tokens", "output": "output_tokens", "cached_input": "cache_read_input_tokens", "cache_creation": "cache_creation_input_tokens", "reasoning": "reasoning_output_tokens"}


def rows_of(lines: DataFrame, subagent: Column | None = None) -> DataFrame:
    """Parsed user and assistant lines with session, turn, model, project and content blocks. ``subagent``: whether a line's file is a sub-agent's."""
    sid = F.col("session_id")
    r = once(parsed(lines).where(F.col("type").isin("user", "assistant")), {"session_id": F.coalesce(js("sessionId"), js("session_id")), "usage": js("message.usage"), "cwd": text("cwd"), "model": js("message.model")})
    return once(r, {
        "session_hash": hash_id(F.coalesce(sid, F.col("file_id")), length=16), "turn": F.coalesce(js("message.id"), js("uuid"), F.concat(F.lit("line-"), F.col("line_no").cast("string"))),
        "model": known("model"), "project": F.coalesce(last_component("cwd"), F.lit(UNKNOWN)), "blocks": F.from_json(js("message.content"), BLOCKS),
        "subagent": F.lit(False) if subagent is None else subagent, "has_usage": F.col("usage").isNotNull() & ~F.col("usage").isin("{}", "null"),
    }).drop("usage", "cwd")


def session_events(rows: DataFrame) -> DataFrame:
    """Messages of main transcripts, once per message id; users' lines that a tool or the program wrote are synthetic."""
    tool = F.coalesce(F.exists("blocks", lambda b: b["type"] == "tool_result"), F.lit(False))
    synthetic = F.coalesce(js("isMeta") == "true", F.lit(False)) | F.coalesce(js("message.synthetic") == "true", F.lit(False)) | tool
    role = F.when(F.col("type") == "assistant", "assistant").when(synthetic, "synthetic_user").otherwise("user")
    scope = F.when(F.col("session_id").isNull(), "missing-session").otherwise(F.col("session_hash"))
    ident = F.coalesce(F.concat(F.lit("message:"), F.coalesce(text("message.id"), text("uuid"))), F.concat(F.lit("json:"), F.col("raw")))
    timed = rows.where(~F.col("subagent") & F.col("ts_ms").isNotNull()).withColumn("role", role)
    timed = timed.withColumn("event_id", hash_id("source", F.lit("session-event"), scope, "role", ident))
    first = timed.groupBy("file_id", "event_id").agg(F.min_by(F.struct("source", "session_hash", "role", "ts_ms"), "line_no").alias("r"))
    return first.select("event_id", "r.*", "file_id", F.lit("").alias("hostname"))


def tool_maps(rows: DataFrame) -> DataFrame:
    """``skill_counts`` and ``mcp_counts`` of each line's tool uses."""
    uses = F.filter(F.coalesce("blocks", F.array().cast(BLOCKS)), lambda b: b["type"] == "tool_use")
    skill = F.filter(F.transform(F.filter(uses, lambda b: b["name"] == "Skill"), lambda b: F.coalesce(F.nullif(F.trim(F.get_json_object(b["input"], "$.skill")), F.lit("")), F.nullif(F.trim(F.get_json_object(b["input"], "$.command")), F.lit("")))), lambda x: x.isNotNull())
    server = F.filter(F.transform(uses, lambda b: mcp_server(b["name"])), lambda x: x.isNotNull())
    count = lambda names: F.transform(F.array(names), lambda a: F.map_from_arrays(F.array_sort(F.array_distinct(a)), F.transform(F.array_sort(F.array_distinct(a)), lambda k: F.size(F.filter(a, lambda x: x == k)).cast("long"))))[0]
    named = once(rows, {"skill_counts": skill, "mcp_counts": server})
    return once(named, {"skill_counts": count(F.col("skill_counts")), "mcp_counts": count(F.col("mcp_counts"))})


def turn_sizes(rows: DataFrame) -> DataFrame:
    """``(file_id, turn, thinking, other)``: bytes of a turn's blocks, each distinct block once."""
    each = rows.where(~F.col("subagent") & (F.col("type") == "assistant") & F.col("has_usage")).select("file_id", "turn", F.explode("blocks").alias("b"))
    kind = F.when(F.col("b.type") == "thinking", "t").when(F.col("b.type") == "text", "x").when(F.col("b.type") == "tool_use", "u")
    body = F.when(kind == "t", F.col("b.thinking")).when(kind == "x", F.col("b.text")).otherwise(F.concat(F.coalesce("b.name", F.lit("")), F.coalesce("b.input", F.lit(""))))
    once = each.select("file_id", "turn", kind.alias("kind"), body.alias("body")).where("kind is not null and body <> ''").distinct()
    size = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == "t" if k else F.col("kind") != "t", F.octet_length("body"))), F.lit(0)).alias("thinking" if k else "other")
    return once.groupBy("file_id", "turn").agg(size(True), size(False))


def fold(rows: DataFrame, first_ts: bool) -> list[Column]:
    """Aggregates that make one candidate of a turn's lines: metadata of the first line, models and projects of the first that know them."""
    index = F.col("line_no")
    named = lambda c, ok: F.coalesce(F.min_by(c, F.when(ok, index)), F.lit(UNKNOWN)).alias(c)
    return [
        named("model", ~is_unknown("model")), named("project", F.col("project") != UNKNOWN), F.min_by("session_hash", index).alias("session_hash"), (F.min if first_ts else F.max)("ts_ms").alias("ts_ms"),
        F.min(index).alias("line_no"), map_max("skill_counts").alias("skill_counts"), map_max("mcp_counts").alias("mcp_counts"),
    ]


def family(model: str = "model") -> Column:
    return F.lower(model).rlike("claude|sonnet|haiku|opus")


def usage_events(rows: DataFrame) -> DataFrame:
    """One event per message with its largest counts, and one count-only event per turn whose tools have no usage."""
    a = tool_maps(rows.where("type = 'assistant'")).where(F.col("ts_ms").isNotNull())
    fields = {**USAGE, "total": "total_tokens"}
    used = once(a.where("has_usage"), {c: js(f"message.usage.{p}") for c, p in fields.items()})
    used = once(used, {c: as_number(F.col(c)) for c in fields}).withColumns({c: F.greatest(c, F.lit(0)) for c in USAGE})
    m = used.groupBy("source", "file_id", "turn").agg(*fold(used, True), *[F.max(c).alias(c) for c in [*COUNTS, "total"]], F.bool_or("subagent").alias("subagent"))
    m = m.join(turn_sizes(rows), ["file_id", "turn"], "left")
    split = F.when(~F.col("subagent") & (F.col("reasoning") == 0) & family(), reasoning_split("thinking", "other", "output")).otherwise(0)
    m = m.withColumns({"total": total_of("total"), "moved": split}).withColumns({"output": F.col("output") - F.col("moved"), "reasoning": F.col("reasoning") + F.col("moved")})
    m = m.withColumns({"event_id": hash_id("source", F.concat(F.lit("message:"), "turn")), "merge_strategy": F.lit("overwrite")})
    tools = a.where((F.size("skill_counts") > 0) | (F.size("mcp_counts") > 0)).withColumn("identity", F.concat(F.lit("session:"), "session_hash", F.lit("|turn:"), "turn"))
    t = tools.groupBy("source", "file_id", "identity", "turn").agg(*fold(tools, False))
    t = t.join(used.select("file_id", F.concat(F.lit("session:"), "session_hash", F.lit("|turn:"), "turn").alias("identity")).distinct(), ["file_id", "identity"], "left_anti")
    t = t.withColumns({**{c: F.lit(0).cast("long") for c in [*COUNTS, "total"]}, "event_id": hash_id("source", F.lit("tool-count-only"), "identity"), "merge_strategy": F.lit("cumulativeMax")})
    cols = ["event_id", "source", "model", "project", "ts_ms", *COUNTS, "total", "session_hash", "file_id"]
    more = [F.col("session_hash").alias("rollout_key"), F.lit("").alias("parent_rollout_key"), F.lit(False).alias("inherited"), F.lit(False).alias("has_total_snapshot"), F.lit("").alias("lineage_fingerprint"), F.lit("").alias("dedup_key"), "merge_strategy", "skill_counts", "mcp_counts", F.lit("").alias("hostname")]
    return m.select(*cols, *more).unionByName(t.select(*cols, *more))


def edit_entries(rows: DataFrame) -> DataFrame:
    """Lines added and deleted by edits whose last result is no error; calls without a time are left out."""
    from tallyloom.functions.code import edit_lines

    each = rows.select("file_id", "source", "model", "project", "ts_ms", "line_no", "type", F.explode("blocks").alias("b"))
    calls = each.where((F.col("b.type") == "tool_use") & F.col("b.name").isin("Edit", "Write", "NotebookEdit", "MultiEdit") & (F.col("b.id") != "") & F.col("ts_ms").isNotNull())
    calls = once(calls, {"d": edit_lines("b.name", "b.input")}).where("d.added > 0 or d.deleted > 0")
    last = calls.groupBy("file_id", F.col("b.id").alias("tool_use_id")).agg(F.max_by(F.struct("source", "model", "project", "ts_ms", F.col("d.added").alias("added"), F.col("d.deleted").alias("deleted")), "line_no").alias("e"))
    done = each.where((F.col("b.type") == "tool_result") & (F.col("b.tool_use_id") != "")).groupBy("file_id", F.col("b.tool_use_id").alias("tool_use_id")).agg(F.max_by(~F.coalesce("b.is_error", F.lit(False)), "line_no").alias("ok"))
    return last.join(done, ["file_id", "tool_use_id"]).where("ok").select("tool_use_id", "e.*", "file_id", F.lit("").alias("hostname"))

"""Edits, skills and MCP calls of rollout files: calls joined with their outputs, which may come in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import code
from tallyloom.functions.exprs import hash_id, known, mcp_server, once, skill_markers
from tallyloom.operators.calls import resolved_calls
from tallyloom.operators.dedup import map_max
from tallyloom.operators.rollout import first_lines_fields, js, session_hash, text
from tallyloom.schemas import COUNTS, UNKNOWN

CALLS = ["custom_tool_call", "function_call"]
EMPTY = "map<string,bigint>"
BEGIN = "*** Begin Patch"


def no_counts() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))


def output_text(raw: Column) -> Column:
    """The output as text, whether it is a string, a list of text parts or an object."""
    parts = F.array_join(F.transform(F.from_json(raw, "array<struct<text:string>>"), lambda x: x["text"]), "\n")
    inner = F.coalesce(F.get_json_object(raw, "$.output"), F.get_json_object(raw, "$.content"))
    return F.coalesce(F.when(raw.startswith("["), F.nullif(parts, F.lit(""))), F.when(raw.startswith("{"), inner), raw)


def items(rows: DataFrame) -> DataFrame:
    """Response items with their call and their text, and the lines that say which file, model and turn they belong to, whose fields are null."""
    item = F.col("type") == "response_item"
    # the payload is read once for all its fields; one that is itself text has no type, and isn't read
    r = once(rows.where(F.col("type").isin("session_meta", "turn_context", "response_item")), {"payload": F.when(item & F.col("ptype").isNotNull(), js("payload"))})
    fields = ["call_id", "name", "input", "arguments", "output"]
    r = r.select(*rows.columns, F.json_tuple("payload", *fields).alias(*fields))
    args = F.col("arguments")
    inner = F.when(args.contains(":"), F.coalesce(*[F.get_json_object(args, f"$.{c}") for c in ("input", "cmd", "command")]))
    return once(r, {"name": F.when(item, F.coalesce("name", F.lit(""))), "body": F.coalesce("input", inner, args), "is_output": item & F.col("ptype").endswith("_call_output"), "output": output_text(F.col("output"))}).drop("input")


KEPT = ["file_id", "source", "line_no", "ts_ms", "call_id", "is_output"]


def in_context(rows: DataFrame, wanted: dict[str, Column], any_of_file: str | None = None) -> DataFrame:
    """The items that have one of ``wanted`` or are outputs, with these columns and the model, turn, project and session that hold where they stand; ``in_file`` says whether a line of the file has ``any_of_file``.

    A file's lines come together once, with what is wanted of them and without their text. The columns of the outcome are made in one step that neither filters nor
    choices of columns go through, so that all that is taken from it, however different, reads the same shuffle. Only ``file_id`` goes past that step, so that groups of a file's
    rows need no second shuffle; filters and joins are to use its copy ``file``.
    """
    order = Window.partitionBy("file_id").orderBy("line_no")
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ctx, item = F.col("type") == "turn_context", F.col("type") == "response_item"
    turn = F.coalesce(text("payload.turn_id"), text("payload.id"), F.concat(F.lit("context:"), F.sha2(js("payload"), 256)))
    said = {"meta": F.when(F.col("type") == "session_meta", first_lines_fields()), "ctx_model": F.when(ctx, text("payload.model")), "ctx_turn": F.when(ctx, turn)}
    r = once(rows, wanted | said).select(*KEPT, *wanted, *said, item.alias("item"))
    r = r.where(~F.col("item") | F.col("is_output") | F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in wanted], F.lit(False)))
    r = r.withColumns({"meta": F.first("meta", ignorenulls=True).over(whole), "model": F.coalesce(F.last("ctx_model", ignorenulls=True).over(so_far), F.lit(UNKNOWN)), "turn": F.coalesce(F.last("ctx_turn", ignorenulls=True).over(so_far), F.lit("pre-context"))})
    r = r.withColumn("in_file", F.max(F.col(any_of_file).isNotNull()).over(whole) if any_of_file else F.lit(False))
    r = r.where("item").withColumns({"rollout_key": F.coalesce("meta.rollout_key", F.lit("")), "project": F.coalesce("meta.project", F.lit(UNKNOWN))})
    made = {"file": F.col("file_id"), **{c: F.col(c) for c in [*KEPT[1:], *wanted, "in_file", "project", "model", "turn"]}, "session_hash": session_hash()}
    return once(r, made).select("file_id", *made)


def edit_entries(rows: DataFrame) -> DataFrame:
    """Lines that applied patches add and delete. A patch inside a script counts by the script's own status; calls without a time are left out."""
    call = F.col("ptype").isin(*CALLS) & F.col("call_id").isNotNull() & F.col("ts_ms").isNotNull() & F.col("body").contains("Begin Patch")
    ok = F.struct(code.exec_applied("output").alias("plain"), (code.programmatic_state("output") == "completed").alias("script"))
    i = in_context(items(rows), {"patch": F.when(call, F.col("body")), "ok": F.when(F.col("is_output"), ok)})
    script = F.col("patch").contains("tools.apply_patch")
    calls = i.where("patch is not null").withColumn("script", script).withColumn("patch", F.when(F.col("script"), code.script_patch_body("patch")).otherwise(F.col("patch")))
    calls = once(calls, {"d": code.patch_lines("patch")}).where("d.added > 0 or d.deleted > 0")
    calls = calls.select("file_id", "call_id", "line_no", "source", "model", "project", "ts_ms", F.col("d.added").alias("added"), F.col("d.deleted").alias("deleted"), "script")
    outs = i.where("is_output").select("file_id", "call_id", "line_no", "ok")
    last = outs.groupBy("file_id", "call_id").agg(F.max_by("ok", "line_no").alias("ok"))
    first = calls.groupBy("file_id", "call_id").agg(F.max_by(F.struct(*[c for c in calls.columns if c not in ("file_id", "call_id")]), "line_no").alias("c")).select("file_id", "call_id", "c.*")
    done = first.join(last, ["file_id", "call_id"]).where(F.when(F.col("script"), F.col("ok.script")).otherwise(F.col("ok.plain")))
    return done.select(F.col("call_id").alias("tool_use_id"), "source", "model", "project", "ts_ms", "added", "deleted", "file_id", F.lit("").alias("hostname"))


def skipped_edits(rows: DataFrame) -> DataFrame:
    """A diagnostic for each patch call without a time."""
    bad = items(rows).where((F.col("type") == "response_item") & F.col("ptype").isin(*CALLS) & F.col("ts_ms").isNull() & F.col("body").contains("Begin Patch"))
    return bad.select("file_id", F.concat(F.lit("line "), (F.col("line_no") + 1).cast("string"), F.lit(": edit call skipped (missing timestamp)")).alias("message"))


def message_text() -> Column:
    raw = js("payload.content")
    parts = F.transform(F.from_json(raw, "array<struct<text:string,input_text:string>>"), lambda x: F.coalesce(F.nullif(x["text"], F.lit("")), x["input_text"]))
    return F.coalesce(F.when(raw.startswith("["), F.array_join(parts, "\n")), raw)


def count_events(rows: DataFrame) -> DataFrame:
    """Count-only usage events: skills read or named, and MCP calls whose output says they worked, by turn and call."""
    timed, lower = F.col("ts_ms").isNotNull() & (F.col("type") == "response_item"), F.lower(F.trim("name"))
    shell = lower.rlike("exec|command|shell") & ~lower.rlike("patch|write|edit")
    called, cell = F.col("ptype").isin(*CALLS), lambda c: F.coalesce(F.get_json_object(c, "$.cell_id"), F.get_json_object(c, "$.cellId"))
    i = in_context(items(rows), {
        "read": F.when(timed & (F.col("ptype") == "function_call") & shell & F.col("arguments").contains("/SKILL.md"), F.col("arguments")),
        "names": F.when(timed & (F.col("ptype") == "message") & F.col("raw").contains("/SKILL.md") & (js("payload.role") == "user"), F.filter(skill_markers(message_text()), lambda x: x != "")),
        "server": F.when(timed & (F.col("ptype") == "function_call") & F.col("call_id").isNotNull(), mcp_server("name")),
        "script": F.when(timed & called & F.col("call_id").isNotNull() & F.col("body").contains("tools.mcp__"), F.col("body")),
        "wait": F.when((F.col("type") == "response_item") & called & lower.contains("wait"), F.struct(F.coalesce(cell("arguments"), cell("body")).alias("cell_id"))),
        "output": F.when(F.col("is_output"), F.col("output")),
    }, "script")
    keep = ["file_id", "call_id", "line_no", "source", "model", "project", "turn", "ts_ms", "session_hash"]
    skills = i.where("read is not null or names is not null").withColumn("read", code.skill_reads("read"))
    skills = skills.withColumn("skill_counts", F.when(F.col("names").isNull(), F.col("read")).otherwise(F.map_from_arrays("names", F.transform("names", lambda x: F.lit(1).cast("long")))))
    skills = skills.select(*keep, "skill_counts").where(F.size("skill_counts") > 0).withColumn("mcp_counts", no_counts())

    # a call and its outputs lie in one file's rows, so its last row and its last output are found in one pass
    fields = [c for c in keep if c not in ("file_id", "call_id")]
    calls = i.where("(server is not null or is_output) and call_id is not null and file is not null").groupBy("file_id", "call_id").agg(F.max_by(F.struct(*fields, "server"), F.when(F.col("server").isNotNull(), F.col("line_no"))).alias("c"), F.max_by("output", F.when(F.col("is_output"), F.col("line_no"))).alias("output"))
    plain = calls.where("c is not null and output is not null").withColumn("ok", code.mcp_worked("output")).where("ok")
    plain = plain.select("file_id", "call_id", "c.*").withColumn("mcp_counts", F.create_map("server", F.lit(1).cast("long"))).drop("server")

    i = i.drop("file_id").withColumnRenamed("file", "file_id")
    script = i.where("script is not null")
    # calls, waits and outputs of the files that have a script; a line may be a call and a wait
    row = lambda where, kind, cell_id, state: F.when(F.expr(where), F.struct(F.lit(kind).alias("kind"), cell_id.cast("string").alias("cell_id"), state.cast("string").alias("state")))
    kinds = [row("script is not null", "call", F.lit(None), F.lit(None)), row("wait is not null", "wait", F.col("wait.cell_id"), F.lit(None)), row("is_output", "output", code.running_cell("output"), code.programmatic_state("output"))]
    chain = i.where("in_file and file_id is not null").select("file_id", "line_no", "call_id", F.inline(F.array_compact(F.array(*kinds))))
    done = resolved_calls(chain).where("done").select("file_id", "call_id")
    programmed = script.join(done, ["file_id", "call_id"], "left_semi").withColumn("mcp_counts", code.script_tools("script")).where(F.size("mcp_counts") > 0)

    mcp = plain.select(*keep, "mcp_counts").unionByName(programmed.select(*keep, "mcp_counts")).withColumn("skill_counts", no_counts())
    all_ = skills.unionByName(mcp).withColumn("identity", F.concat_ws("|", "turn", F.coalesce("call_id", F.lit(""))))
    found = all_.groupBy("source", "file_id", "identity").agg(
        known(F.max_by("model", "ts_ms")).alias("model"), F.first("project").alias("project"), F.max("ts_ms").alias("ts_ms"), F.first("session_hash").alias("session_hash"), map_max("skill_counts").alias("skill_counts"), map_max("mcp_counts").alias("mcp_counts")
    )
    return found.select(
        hash_id("source", F.lit("tool-count-only"), "session_hash", "identity").alias("event_id"), "source", "model", "project", "ts_ms", *[F.lit(0).cast("long").alias(c) for c in [*COUNTS, "total"]], "session_hash", "file_id",
        F.col("session_hash").alias("rollout_key"), F.lit("").alias("parent_rollout_key"), F.lit(False).alias("inherited"), F.lit(False).alias("has_total_snapshot"), F.lit("").alias("lineage_fingerprint"), F.lit("").alias("dedup_key"),
        F.lit("cumulativeMax").alias("merge_strategy"), "skill_counts", "mcp_counts", F.lit("").alias("hostname"),
    )

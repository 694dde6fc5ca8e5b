"""Log parsers over lines that are made from the tables' columns, so that plain SQL over the same columns tells what they must find."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import code
from tallyloom.functions import exprs as X
from tallyloom.operators import calls, curves, incremental, rollout, rollout_tools, sessions, signals, transcript, usage
from tallyloom.plans.catalogue import ORACLE, query
from tallyloom.plans.tables import USAGE
from tallyloom.plans.tables import usage as usage_rows
from tallyloom.sources import lines as readers
from tallyloom.sources import payloads

ISO = "strftime(make_timestamp(ts_ms*1000),'%Y-%m-%dT%H:%M:%S.%g')||'Z'"  # how the oracle would write a line's time
V = f"WITH {USAGE}"


def filled(template: str, **more: Column) -> Column:
    """The template with ``<column>`` replaced by that column's value, or by one of ``more``."""
    parts = re.split(r"<(\w+)>", template)
    cells = [F.lit(p) if k % 2 == 0 else more.get(p, F.col(p)).cast("string") for k, p in enumerate(parts)]
    return F.concat(*[F.coalesce(c, F.lit("")) for c in cells])


def made(spark, d, raw: Column, source: str = "codex") -> DataFrame:
    """``(file_id, source, line_no, raw)`` and the columns that lines are made of: a file for each user, a line for each event."""
    u = usage_rows(spark, d).withColumns({"file": F.col("session_hash"), "at": F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")})
    return X.once(u.drop("source", "file_id").select("*", F.col("file").alias("file_id"), F.lit(source).alias("source"), F.col("n").alias("line_no")), {"raw": raw})


def lines_only(df: DataFrame) -> DataFrame:
    return df.select("file_id", "source", "line_no", "raw")


def when(*pairs, other=None) -> Column:
    """The value of the first condition that holds; conditions are SQL text."""
    out = F
    for condition, value in pairs:
        out = out.when(F.expr(condition), value)
    return out.otherwise(other)


# -- rollout files -------------------------------------------------------------------------------

_META = '{"timestamp":"<at>","type":"session_meta","payload":{"id":"r<n>","session_id":"s<n>","cwd":"/home/x/<project>/"<parent><fork>}}'


@query("p01_rollout_metadata", f"""{V}, f AS (SELECT *, row_number() OVER (PARTITION BY session_hash ORDER BY n) AS rn FROM usage WHERE n%10=0)
 SELECT session_hash AS file_id, left(sha256('r'||n),16) AS rollout_key, 's'||n AS session_id, project, CASE WHEN (n%20=0)<>(n%30=0) THEN left(sha256(CASE WHEN n%20=0 THEN 'q' ELSE 'z' END||k),16) ELSE '' END AS parent_rollout_key,
 n%20=0 OR n%30=0 AS has_parent, n%20=0 AND n%30=0 AS parent_conflict FROM f WHERE rn=1""")  # fmt: skip
def p01(spark, d):
    parent = F.when(F.expr("n % 20 = 0"), filled(',"parent_thread_id":"q<k>"')).otherwise("")
    fork = F.when(F.expr("n % 30 = 0"), filled(',"forked_from_id":"z<k>"')).otherwise("")
    return rollout.metadata(rollout.parsed(lines_only(made(spark, d, filled(_META, parent=parent, fork=fork)).where("n % 10 = 0"))))


_COUNTS = '{"timestamp":"<when>","type":"event_msg","payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":<input>,"cached_input_tokens":<k>,"cache_read_input_tokens":<cache_creation>,"cache_creation_input_tokens":<k>,"output_tokens":<output>,"reasoning_output_tokens":<reasoning>,"total_tokens":<total>}}}}'
_ROLLOUT = """c AS (SELECT *, least(input, k+cache_creation) AS hit FROM usage), parts AS (SELECT *, least(greatest(input-hit,0),k) AS made, least(output,reasoning) AS think, greatest(total,input+output) AS all_ FROM c)"""


@query("p06_token_events", f"{V}, {_ROLLOUT} SELECT session_hash AS file_id, ts_ms, 'unknown' AS model, input-hit-made AS input, output-think AS output, hit AS cached_input, made AS cache_creation, think AS reasoning, all_ AS total FROM parts WHERE n%7<>0 AND all_>0")
def p06(spark, d):
    rows = lines_only(made(spark, d, filled(_COUNTS, when=F.when(F.expr("n % 7 = 0"), "someday").otherwise(F.col("at")))))
    return rollout.usage_events(rollout.parsed(rows)).select("file_id", "ts_ms", "model", "input", "output", "cached_input", "cache_creation", "reasoning", "total")


@query("p06_token_diagnostics", f"{V} SELECT session_hash AS file_id, 'line '||(n+1)||': invalid timestamp (usage skipped)' AS message FROM usage WHERE n%7=0")
def p06_diagnostics(spark, d):
    rows = lines_only(made(spark, d, filled(_COUNTS, when=F.when(F.expr("n % 7 = 0"), "someday").otherwise(F.col("at")))))
    return rollout.diagnostics(rollout.parsed(rows))


@query("p10_event_ids", f"""{V}, {_ROLLOUT}, i AS (SELECT session_hash, n, sha256(concat_ws('|','codex-token','missing-rollout','unknown',input-hit-made,output-think,hit,made,think,all_,'incomplete')) AS base FROM parts WHERE n%7<>0 AND all_>0),
 r AS (SELECT *, row_number() OVER (PARTITION BY session_hash, base ORDER BY n)-1 AS nth FROM i) SELECT session_hash AS file_id, CASE WHEN nth=0 THEN base ELSE base||'#'||nth END AS event_id, '' AS lineage_fingerprint, '' AS dedup_key FROM r""")  # fmt: skip
def p10(spark, d):
    rows = lines_only(made(spark, d, filled(_COUNTS, when=F.when(F.expr("n % 7 = 0"), "someday").otherwise(F.col("at")))))
    return rollout.usage_events(rollout.parsed(rows)).select("file_id", "event_id", "lineage_fingerprint", "dedup_key")


@query("p05_complete_snapshot", f"{V} SELECT n, n%4=0 AND n%5<>0 AND n%7<>0 AS complete FROM usage")
def p05(spark, d):
    inp = when(("n % 5 = 0", F.lit("true")), ("n % 7 = 0", F.concat(F.col("input").cast("string"), F.lit(".5"))), other=F.col("input").cast("string"))
    whole = F.when(F.expr("n % 4 = 0"), F.col("input") + F.col("output")).otherwise(F.col("input") + F.col("output") + 1)
    rows = made(spark, d, filled('{"t":{"input_tokens":<inp>,"output_tokens":<output>,"total_tokens":<whole>}}', inp=inp, whole=whole))
    return rows.select("n", rollout.complete_snapshot("t").alias("complete"))


@query("p07_rollout_roles", f"{V} SELECT session_hash AS file_id, CASE n%4 WHEN 0 THEN 'synthetic_user' WHEN 1 THEN 'user' ELSE 'assistant' END AS role, count(*) AS n, min(ts_ms) AS first_ms FROM usage WHERE n%9<>0 GROUP BY 1,2")
def p07(spark, d):
    kind = when(("n % 4 = 0", F.lit("session_meta")), ("n % 4 = 1", F.lit("turn_context")), ("n % 4 = 2", F.lit("response_item")), other=F.lit("event_msg"))
    rows = made(spark, d, filled('{"timestamp":"<when>","type":"<kind>","payload":{"id":"x<n>","type":"message"}}', kind=kind, when=F.when(F.expr("n % 9 = 0"), "").otherwise(F.col("at"))))
    return rollout.session_events(rollout.parsed(lines_only(rows))).groupBy("file_id", "role").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"))


_PATCH = "*** Begin Patch\\\\n*** Update File: <path>\\\\n@@\\\\n<plus><minus>*** Update File: src/package-lock.json\\\\n+skip\\\\n*** End Patch"


@query("f23_patch_lines", f"{V} SELECT n, CASE WHEN n%3=0 THEN 0 ELSE k%5 END AS added, CASE WHEN n%3=0 THEN 0 ELSE n%4 END AS deleted FROM usage")
def f23(spark, d):
    path = F.when(F.expr("n % 3 = 0"), "web/yarn.lock").otherwise("src/a.py")
    text = filled(_PATCH.replace("\\\\n", "\n"), path=path, plus=F.repeat(F.lit("+x\n"), (F.col("k") % 5).cast("int")), minus=F.repeat(F.lit("-y\n"), (F.col("n") % 4).cast("int")))
    return usage_rows(spark, d).select("n", code.patch_lines(text).alias("c")).select("n", F.col("c.added").cast("long").alias("added"), F.col("c.deleted").cast("long").alias("deleted"))


@query("j01_rollout_edits", f"{V} SELECT 'c'||n AS tool_use_id, 'codex' AS source, 'unknown' AS model, ts_ms, k%5 AS added, n%4 AS deleted, session_hash AS file_id FROM usage WHERE n%2=0 AND n%3<>0 AND k%5+n%4>0")
def j01(spark, d):
    """Patch calls and their outputs; odd calls fail, and every third patch is of a generated file."""
    more = {"path": F.when(F.expr("n % 3 = 0"), "web/yarn.lock").otherwise("src/a.py"), "plus": F.repeat(F.lit("+x\\n"), (F.col("k") % 5).cast("int")), "minus": F.repeat(F.lit("-y\\n"), (F.col("n") % 4).cast("int"))}
    call = made(spark, d, filled('{"timestamp":"<at>","type":"response_item","payload":{"type":"custom_tool_call","call_id":"c<n>","name":"apply_patch","input":"' + _PATCH.replace("\\\\n", "\\n") + '"}}', **more))
    said = F.when(F.expr("n % 2 = 0"), "Success. Updated the following files:").otherwise("Exit code: 1")
    out = made(spark, d, filled('{"timestamp":"<at>","type":"response_item","payload":{"type":"custom_tool_call_output","call_id":"c<n>","output":"<said>"}}', said=said))
    rows = lines_only(call.withColumn("line_no", F.col("n") * 2)).unionByName(lines_only(out.withColumn("line_no", F.col("n") * 2 + 1)))
    return rollout_tools.edit_entries(rollout.parsed(rows)).select("tool_use_id", "source", "model", "ts_ms", F.col("added").cast("long").alias("added"), F.col("deleted").cast("long").alias("deleted"), "file_id")


@query("a04_rollout_tool_counts", f"{V} SELECT session_hash AS file_id, ts_ms, 'srv'||(k%3)||'=1' AS counts FROM usage WHERE n%2=0")
def a04(spark, d):
    """MCP calls whose output says that they worked; odd ones fail."""
    call = made(spark, d, filled('{"timestamp":"<at>","type":"response_item","payload":{"type":"function_call","call_id":"c<n>","name":"mcp__srv<server>__do","arguments":"{}"}}', server=F.col("k") % 3))
    out = made(spark, d, filled('{"timestamp":"<at>","type":"response_item","payload":{"type":"function_call_output","call_id":"c<n>","output":"<said>"}}', said=F.when(F.expr("n % 2 = 0"), "ten rows").otherwise("error: no such table")))
    rows = lines_only(call.withColumn("line_no", F.col("n") * 2)).unionByName(lines_only(out.withColumn("line_no", F.col("n") * 2 + 1)))
    return rollout_tools.count_events(rollout.parsed(rows)).select("file_id", "ts_ms", X.counts_text("mcp_counts").alias("counts"))


@query("j03_wait_cells", f"{V} SELECT session_hash AS file_id, 'c'||n AS call_id, n%2=0 AS done FROM usage WHERE n%5<>0")
def j03(spark, d):
    """Calls that hand over to a cell whose wait ends them; of every fifth the wait never ends."""
    u = usage_rows(spark, d)
    row = lambda k, kind, call, cell, state: F.struct((F.col("n") * 4 + k).alias("line_no"), F.lit(kind).alias("kind"), call.alias("call_id"), cell.alias("cell_id"), state.alias("state"))
    no, c, w, cell = F.lit(None).cast("string"), filled("c<n>"), filled("w<n>"), filled("z<n>")
    last = when(("n % 5 = 0", F.lit("running")), ("n % 2 = 0", F.lit("completed")), other=F.lit("failed"))
    steps = F.array(row(0, "call", c, no, no), row(1, "output", c, cell, F.lit("running")), row(2, "wait", w, cell, no), row(3, "output", w, cell, last))
    return calls.resolved_calls(u.select(F.col("session_hash").alias("file_id"), F.explode(steps).alias("s")).select("file_id", "s.*"))


# -- transcripts ---------------------------------------------------------------------------------


def transcript_rows(spark, d, raw: Column, where: str = "true") -> DataFrame:
    return transcript.rows_of(lines_only(made(spark, d, raw, "claude").where(where)))


@query("p08_transcript_roles", f"{V} SELECT left(sha256(session_hash),16) AS session_hash, CASE WHEN n%2=0 THEN 'assistant' WHEN n%3=0 OR n%5=0 OR n%7=0 THEN 'synthetic_user' ELSE 'user' END AS role, count(*) AS n FROM usage GROUP BY 1,2")
def p08(spark, d):
    kind, meta, made_up = F.when(F.expr("n % 2 = 0"), "assistant").otherwise("user"), F.expr("n % 3 = 0"), F.expr("n % 5 = 0")
    block = F.when(F.expr("n % 7 = 0"), '[{"type":"tool_result","tool_use_id":"t"}]').otherwise('"hello"')
    raw = filled('{"timestamp":"<at>","type":"<kind>","sessionId":"<file>","isMeta":<meta>,"message":{"id":"m<n>","synthetic":<made_up>,"content":<block>}}', kind=kind, meta=meta, made_up=made_up, block=block)
    return transcript.session_events(transcript_rows(spark, d, raw)).groupBy("session_hash", "role").agg(F.count("*").alias("n"))


@query("p09_message_identity", f"{V}, r AS (SELECT *, row_number() OVER (PARTITION BY session_hash, n//3 ORDER BY n) AS rn FROM usage) SELECT session_hash AS file_id, sha256('claude|session-event|'||left(sha256(session_hash),16)||'|user|message:m'||(n//3)) AS event_id, ts_ms FROM r WHERE rn=1")
def p09(spark, d):
    raw = filled('{"timestamp":"<at>","type":"user","sessionId":"<file>","message":{"id":"m<group>","content":"x"}}', group=F.floor(F.col("n") / 3))
    return transcript.session_events(transcript_rows(spark, d, raw)).select("file_id", "event_id", "ts_ms")


_MESSAGE = '{"timestamp":"<at>","type":"assistant","sessionId":"<file>","cwd":"/w/<project>","message":{"id":"m<group>","model":"<model>","content":[],"usage":{"input_tokens":<input>,"output_tokens":<output>,"cache_read_input_tokens":<cached_input>,"cache_creation_input_tokens":<cache_creation>,"reasoning_output_tokens":<reasoning>}}}'


@query("a02_message_fold", f"""{V}, g AS (SELECT session_hash, n//3 AS g, arg_min(model,n) AS model, arg_min(project,n) AS project, min(ts_ms) AS ts_ms, max(input) AS input, max(output) AS output, max(cached_input) AS cached_input, max(cache_creation) AS cache_creation, max(reasoning) AS reasoning FROM usage GROUP BY 1,2)
 SELECT session_hash AS file_id, sha256('claude|message:m'||g) AS event_id, model, project, ts_ms, input, output, cached_input, cache_creation, reasoning, input+output+cached_input+cache_creation+reasoning AS total FROM g""")  # fmt: skip
def a02(spark, d):
    out = transcript.usage_events(transcript_rows(spark, d, filled(_MESSAGE, group=F.floor(F.col("n") / 3))))
    return out.select("file_id", "event_id", "model", "project", "ts_ms", "input", "output", "cached_input", "cache_creation", "reasoning", "total")


@query("p04_transcript_tokens", f"{V} SELECT session_hash AS file_id, sha256('claude|message:m'||n) AS event_id, input, output, cached_input, cache_creation, reasoning FROM usage")
def p04(spark, d):
    return transcript.usage_events(transcript_rows(spark, d, filled(_MESSAGE, group=F.col("n")))).select("file_id", "event_id", "input", "output", "cached_input", "cache_creation", "reasoning")


@query("a03_tool_only_fold", f"""{V}, g AS (SELECT session_hash, n//4 AS g, max(ts_ms) AS ts_ms, string_agg(DISTINCT 'srv'||(k%3)||'=1', ',' ORDER BY 'srv'||(k%3)||'=1') AS counts, bool_or(n%9=0) AS used FROM usage GROUP BY 1,2)
 SELECT session_hash AS file_id, ts_ms, counts FROM g WHERE NOT used""")  # fmt: skip
def a03(spark, d):
    used = F.when(F.expr("n % 9 = 0"), ',"usage":{"input_tokens":5}').otherwise("")
    raw = filled('{"timestamp":"<at>","type":"assistant","sessionId":"<file>","message":{"id":"t<group>","content":[{"type":"tool_use","id":"u<n>","name":"mcp__srv<server>__do","input":{}}]<used>}}', group=F.floor(F.col("n") / 4), server=F.col("k") % 3, used=used)
    return transcript.usage_events(transcript_rows(spark, d, raw)).where("merge_strategy = 'cumulativeMax'").select("file_id", "ts_ms", X.counts_text("mcp_counts").alias("counts"))


@query("f13_tool_use_counts", f"{V} SELECT n, CASE WHEN n%3=0 THEN 's'||(k%4)||'=2' ELSE '' END AS skills, 'srv='||(CASE WHEN n%2=0 THEN 2 ELSE 1 END) AS servers FROM usage")
def f13(spark, d):
    skill = F.when(F.expr("n % 3 = 0"), filled('{"type":"tool_use","name":"Skill","input":{"skill":"s<x>"}},{"type":"tool_use","name":"Skill","input":{"command":" s<x> "}},', x=F.col("k") % 4)).otherwise("")
    again = F.when(F.expr("n % 2 = 0"), ',{"type":"tool_use","name":"mcp__srv__b","input":{}}').otherwise("")
    raw = filled('{"timestamp":"<at>","type":"assistant","uuid":"<n>","message":{"content":[<skill>{"type":"tool_use","name":"mcp__srv__a","input":{}},{"type":"text","text":"mcp__no__x"}<again>]}}', skill=skill, again=again)
    out = transcript.tool_maps(transcript_rows(spark, d, raw))
    return out.select(F.col("line_no").alias("n"), X.counts_text("skill_counts").alias("skills"), X.counts_text("mcp_counts").alias("servers"))


@query("a25_turn_sizes", f"""{V}, b AS (SELECT session_hash, n//3 AS g, 't' AS kind, 2*(k%10) AS size FROM usage UNION SELECT session_hash, n//3, 'x', n%4 FROM usage)
 SELECT session_hash AS file_id, 'm'||g AS turn, CAST(sum(size) FILTER (kind='t') AS BIGINT) AS thinking, CAST(sum(size) FILTER (kind='x') AS BIGINT) AS other FROM b GROUP BY 1,2 HAVING sum(size)>0""")  # fmt: skip
def a25(spark, d):
    raw = filled('{"timestamp":"<at>","type":"assistant","sessionId":"<file>","message":{"id":"m<group>","content":[{"type":"thinking","thinking":"<t>"},{"type":"text","text":"<x>"},{"type":"text","text":"<x>"}],"usage":{"input_tokens":1}}}',
                 group=F.floor(F.col("n") / 3), t=F.repeat(F.lit("é"), (F.col("k") % 10).cast("int")), x=F.repeat(F.lit("y"), (F.col("n") % 4).cast("int")))
    return transcript.turn_sizes(transcript_rows(spark, d, raw))


_EDIT = '{"timestamp":"<at>","type":"<kind>","sessionId":"<file>","cwd":"/w/<project>","message":{"id":"m<n>","model":"<model>","content":[<block>]}}'


@query("j02_edit_results", f"{V} SELECT 'u'||n AS tool_use_id, 'claude' AS source, model, project, ts_ms, k%5+1 AS added, CAST(0 AS BIGINT) AS deleted, session_hash AS file_id FROM usage WHERE n%3<>0")
def j02(spark, d):
    """Files written, and results of which every third is an error."""
    call = filled(_EDIT, kind=F.lit("assistant"), block=filled('{"type":"tool_use","id":"u<n>","name":"Write","input":{"file_path":"a.py","content":"<text>"}}', text=F.repeat(F.lit("x\\n"), (F.col("k") % 5 + 1).cast("int"))))
    done = filled(_EDIT, kind=F.lit("user"), block=filled('{"type":"tool_result","tool_use_id":"u<n>","is_error":<bad>}', bad=F.expr("n % 3 = 0")))
    rows = lines_only(made(spark, d, call, "claude").withColumn("line_no", F.col("n") * 2)).unionByName(lines_only(made(spark, d, done, "claude").withColumn("line_no", F.col("n") * 2 + 1)))
    out = transcript.edit_entries(transcript.rows_of(rows))
    return out.select("tool_use_id", "source", "model", "project", "ts_ms", F.col("added").cast("long").alias("added"), F.col("deleted").cast("long").alias("deleted"), "file_id")


# -- live lines ----------------------------------------------------------------------------------

NOW_MS = 1_900_000_000_000


@query("p12_signal_time", f"{V} SELECT n, CASE n%6 WHEN 4 THEN {NOW_MS} WHEN 5 THEN {NOW_MS} WHEN 3 THEN ts_ms//1000*1000 ELSE ts_ms END AS ms FROM usage")
def p12(spark, d):
    raw = when(("n % 6 = 0", filled('{"timestamp":"<at>","ts":1}')), ("n % 6 = 1", filled('{"ts":<ts_ms>}')), ("n % 6 = 2", filled('{"timestamp":"no","created_at":"<at>"}')), ("n % 6 = 3", filled('{"createdAt":<s>}', s=F.floor(F.col("ts_ms") / 1000))),
               ("n % 6 = 4", F.lit('{"timestamp":"2099-01-01T00:00:00Z"}')), other=F.lit('{"x":1}'))
    return made(spark, d, raw).select("n", F.unix_millis(signals.signal_time(F.timestamp_millis(F.lit(NOW_MS)))).alias("ms"))


@query("p13_output_tokens", f"{V} SELECT n, CASE WHEN n%7=6 THEN NULL ELSE output END AS tokens FROM usage")
def p13(spark, d):
    raw = when(("n % 7 = 0", filled('{"payload":{"info":{"last_token_usage":{"output_tokens":<output>},"total_token_usage":{"output_tokens":7}}}}')), ("n % 7 = 1", filled('{"payload":{"info":{"total_token_usage":{"outputTokens":<output>}}}}')),
               ("n % 7 = 2", filled('{"usage":{"completion_tokens":<output>}}')), ("n % 7 = 3", filled('{"message":{"usage":{"completionTokens":"<output>"}}}')), ("n % 7 = 4", filled('{"output_tokens":<output>}')),
               ("n % 7 = 5", filled('{"deep":{"er":[{"output_tokens":<output>}]}}')), other=F.lit('{"message":{"usage":{"input_tokens":4}}}'))
    return made(spark, d, raw).select("n", signals.output_tokens().alias("tokens"))


@query("p14_cumulative_tokens", f"{V} SELECT n, CASE WHEN n%4=3 THEN NULL ELSE output END AS total FROM usage")
def p14(spark, d):
    raw = when(("n % 4 = 0", filled('{"a":{"total_output_tokens":<output>}}')), ("n % 4 = 1", filled('{"totalOutputTokens":<output>,"output_tokens":1}')), ("n % 4 = 2", filled('{"payload":{"info":{"total_token_usage":{"output_tokens":<output>}}}}')), other=filled('{"output_tokens":<output>}'))
    return made(spark, d, raw).select("n", signals.cumulative_tokens().alias("total"))


_NAMED = [("n % 6 = 0", '{"model":" <model> "}'), ("n % 6 = 1", '{"type":"turn_context","payload":{"model":"<model>"}}'), ("n % 6 = 2", '{"payload":{"thread_settings":{"model":"<model>"}}}'), ("n % 6 = 3", '{"message":{"model":"<model>"}}'), ("n % 6 = 4", '{"model":"","payload":{"message":{"model":"<model>"}}}')]


def named_lines(spark, d) -> DataFrame:
    return made(spark, d, when(*[(c, filled(t)) for c, t in _NAMED], other=F.lit('{"x":1}')))


@query("p15_model_name", f"{V} SELECT n, CASE WHEN n%6=5 THEN NULL ELSE model END AS model, CASE WHEN n%6=1 THEN model END AS context FROM usage")
def p15(spark, d):
    return named_lines(spark, d).drop("model").select("n", signals.model_name().alias("model"), signals.context_model().alias("context"))


@query("w17_latest_model", f"{V} SELECT session_hash AS file_id, coalesce(arg_max(model,n) FILTER (n%6=1), arg_max(model,n) FILTER (n%6<>5)) AS model FROM usage GROUP BY 1")
def w17(spark, d):
    return signals.latest_model(lines_only(named_lines(spark, d)))


@query("p16_message_identity", f"{V} SELECT n, CASE n%4 WHEN 0 THEN session_hash||'/m'||n WHEN 1 THEN session_hash||'/u'||n WHEN 2 THEN '/m'||n END AS identity FROM usage")
def p16(spark, d):
    raw = when(("n % 4 = 0", filled('{"sessionId":"<file>","uuid":"u<n>","message":{"id":"m<n>"}}')), ("n % 4 = 1", filled('{"session_id":"<file>","uuid":"u<n>","message":{}}')), ("n % 4 = 2", filled('{"message":{"id":"m<n>"}}')), other=filled('{"sessionId":"<file>","uuid":"u<n>"}'))
    return made(spark, d, raw).select("n", F.replace(signals.message_identity(), F.lit("\0"), F.lit("/")).alias("identity"))


@query("p17_top_level", f"{V} SELECT n, n%5 IN (0,1) AS top FROM usage")
def p17(spark, d):
    raw = when(("n % 5 = 0", F.lit('{"type":"session_meta","payload":{"thread_source":"user","source":{"subagent":{}}}}')), ("n % 5 = 1", F.lit('{"type":"session_meta","payload":{"source":"cli"}}')), ("n % 5 = 2", F.lit('{"type":"session_meta","payload":{"source":{"subagent":{"x":1}}}}')),
               ("n % 5 = 3", F.lit('{"type":"other","payload":{"source":"cli"}}')), other=F.lit('{"type":"session_meta","payload":{}}'))
    return made(spark, d, raw).select("n", F.coalesce(signals.top_level(), F.lit(False)).alias("top"))


_NUMBERS = [("n % 7 = 0", "<input>"), ("n % 7 = 1", '"<input>"'), ("n % 7 = 2", "<input>.9"), ("n % 7 = 3", "true"), ("n % 7 = 4", "-1<k>"), ("n % 7 = 5", '"abc"')]


@query("f07_saturating_integer", f"{V} SELECT n, CASE n%7 WHEN 0 THEN input WHEN 1 THEN input WHEN 2 THEN input WHEN 4 THEN 0 WHEN 6 THEN 9223372036854775807 END AS v FROM usage")
def f07(spark, d):
    raw = filled('{"v":<x>}', x=when(*[(c, filled(t)) for c, t in _NUMBERS], other=F.lit("99999999999999999999999")))
    return made(spark, d, raw).select("n", signals.whole(rollout.js("v")).alias("v"))


@query("f06_coerced_integer", f"{V} SELECT n, CASE n%7 WHEN 0 THEN input WHEN 1 THEN input WHEN 2 THEN input WHEN 3 THEN 1 WHEN 4 THEN -CAST('1'||k AS BIGINT) ELSE 0 END AS v FROM usage")
def f06(spark, d):
    raw = filled('{"v":<x>}', x=when(*[(c, filled(t)) for c, t in _NUMBERS], other=F.lit("null")))
    return made(spark, d, raw).select("n", X.coerce_long(F.try_parse_json("raw"), "$.v").alias("v"))


@query("s03_invalid_lines", f"{V} SELECT session_hash AS file_id, n AS line_no, 'line '||(n+1)||': invalid json' AS message FROM usage WHERE n%5 IN (1,2)")
def s03(spark, d):
    raw = when(("n % 5 = 1", F.lit('{"a":')), ("n % 5 = 2", F.lit("[1,2]")), other=filled('{"a":<n>}'))
    return readers.invalid_lines(lines_only(made(spark, d, raw)))


@query("s04_subagent_files", f"{V} SELECT n%3=0 AS subagent, count(*) AS n FROM usage GROUP BY 1")
def s04(spark, d):
    path = when(("n % 3 = 0", filled("/r/<file>/subagents/agent-<n>.jsonl")), ("n % 3 = 1", filled("/r/<file>/subagents/other-<n>.jsonl")), other=filled("/r/agent-<n>.jsonl"))
    return made(spark, d, path).groupBy(readers.subagent_file("raw").alias("subagent")).agg(F.count("*").alias("n"))


# -- saved API answers and processes -------------------------------------------------------------

_ANSWER = '{"apis":{"/v1/<file>":{"models":{"<model>":{"details":[{"timestamp":"<at>","api_key_hash":"<key>","resolved_model":"<resolved>","tokens":{"input_tokens":<input>,"output_tokens":<output>,"reasoning_tokens":<reasoning>,"cached_tokens":<k>,"cache_read_tokens":<cached_input>,"cache_creation_tokens":<cache_creation>,"total_tokens":<zero>}}]}}}}}'


def answers(spark, d) -> DataFrame:
    key = F.sha2(F.when(F.expr("n % 3 = 0"), "other").otherwise("mine"), 256)
    raw = filled(_ANSWER, key=key, resolved=F.when(F.expr("n % 2 = 0"), "").otherwise("gpt-x"), zero=F.lit(0))
    return readers.api_events(made(spark, d, raw).select(F.from_json("raw", readers.API).alias("a")), "mine")


_API = """t AS (SELECT *, least(input, greatest(k, cached_input)) AS hit FROM usage WHERE n%3<>0), p AS (SELECT *, least(greatest(input-hit,0), cache_creation) AS made, least(output, reasoning) AS think FROM t),
 a AS (SELECT DISTINCT session_hash, ts_ms, CASE WHEN n%2=0 THEN model ELSE 'gpt-x' END AS model, model AS key, input, output, k, input-hit-made AS i, output-think AS o, hit, made, think, reasoning, cached_input, cache_creation FROM p WHERE input+output>0)"""


@query("s07_api_events", f"{V}, {_API} SELECT 'cliproxy' AS source, model, 'unknown' AS project, ts_ms, count(*) AS n, CAST(sum(i+o+hit+made+think) AS BIGINT) AS total FROM a GROUP BY ALL")
def s07(spark, d):
    return answers(spark, d).groupBy("source", "model", "project", "ts_ms").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@query("p03_api_tokens", f"{V}, {_API} SELECT model, CAST(sum(i) AS BIGINT) AS input, CAST(sum(o) AS BIGINT) AS output, CAST(sum(hit) AS BIGINT) AS cached_input, CAST(sum(made) AS BIGINT) AS cache_creation, CAST(sum(think) AS BIGINT) AS reasoning FROM a GROUP BY 1")
def p03(spark, d):
    return answers(spark, d).groupBy("model").agg(*[F.sum(c).alias(c) for c in ("input", "output", "cached_input", "cache_creation", "reasoning")])


@query("s09_process_table", f"{V} SELECT n AS pid, CASE WHEN n%5=1 THEN NULL ELSE input*1024 END AS rss_bytes, CAST(k AS DOUBLE)/2 AS cpu, '/opt/my app/bin '||model AS path FROM usage WHERE n%5<>0")
def s09(spark, d):
    cell = F.when(F.expr("n % 5 = 1"), "-").otherwise(F.col("input").cast("string"))
    raw = when(("n % 5 = 0", F.lit("  PID RSS %CPU COMM")), other=filled("  <n> <cell>  <half> /opt/my app/bin <model> ", cell=cell, half=F.col("k") / 2))
    return readers.read_processes(made(spark, d, raw), "raw")


@query("s17_request_text", f"""{V} SELECT n, '{{"model":"'||model||'","input":'||input||CASE WHEN k%5>0 THEN ',"k":'||(k%5) ELSE '' END||CASE WHEN n%2=0 THEN ',"note":"a\\u003cb\\u003e \\u0026 c"' ELSE '' END||'}}' AS body FROM usage""")
def s17(spark, d):
    u = usage_rows(spark, d).withColumns({"k": F.col("k") % 5, "note": F.when(F.expr("n % 2 = 0"), "a<b> & c").otherwise("")})
    return u.select("n", payloads.json_text(u, ["model", "input"], ["k", "note"]).alias("body"))


@query("s20_session_payloads", f"{V}, s AS (SELECT session_hash, min(ts_ms) AS a, max(ts_ms) AS b FROM usage GROUP BY 1) SELECT session_hash, strftime(make_timestamp(a*1000),'%Y-%m-%dT%H:%M:%SZ') AS first_at, strftime(make_timestamp(b*1000),'%Y-%m-%dT%H:%M:%SZ') AS last_at, (b-a)//1000 AS duration_seconds FROM s")
def s20(spark, d):
    s = usage_rows(spark, d).groupBy("session_hash").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    return payloads.session_payloads(s)


# -- code, series and normalisation --------------------------------------------------------------


@query("f20_line_diff", f"{V} SELECT n, n%4 AS added, k%6 AS deleted FROM usage")
def f20(spark, d):
    """Six lines of which the first k % 6 go, and n % 4 new ones come at the end."""
    old = "".join(f"l{k}\n" for k in range(6))
    new = F.concat(F.substring(F.lit(old), (F.col("k") % 6 * 3 + 1).cast("int"), F.lit(99)), F.array_join(F.transform(F.sequence(F.lit(0), (F.col("n") % 4).cast("int")), lambda i: F.when(i > 0, F.concat(F.lit("new"), i.cast("string"), F.lit("\n"))).otherwise("")), ""))
    return usage_rows(spark, d).select("n", code.text_diff(F.lit(old), new).alias("c")).select("n", F.col("c.added").cast("long").alias("added"), F.col("c.deleted").cast("long").alias("deleted"))


@query("f22_tool_edits", f"{V} SELECT n, CAST(CASE n%4 WHEN 0 THEN k%5+1 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS BIGINT) AS added, CAST(CASE n%4 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS deleted FROM usage")
def f22(spark, d):
    name = when(("n % 4 = 0", F.lit("Write")), ("n % 4 = 1", F.lit("Edit")), ("n % 4 = 2", F.lit("MultiEdit")), other=F.lit("Read"))
    text = F.repeat(F.lit("x\\n"), (F.col("k") % 5 + 1).cast("int"))
    args = when(("n % 4 = 0", filled('{"file_path":"a","content":"<text>"}', text=text)), ("n % 4 = 1", F.lit('{"file_path":"a","old_string":"a\\nb\\nc","new_string":"a\\nB\\nc"}')),
                ("n % 4 = 2", F.lit('{"file_path":"a","edits":[{"old_string":"a","new_string":"a\\nb"},{"old_string":"q","new_string":"x\\ny"}]}')), other=F.lit('{"file_path":"a","content":"z"}'))
    return usage_rows(spark, d).select("n", code.edit_lines(name, args).alias("c")).select("n", F.col("c.added").cast("long").alias("added"), F.col("c.deleted").cast("long").alias("deleted"))


@query("f24_exec_gates", f"{V} SELECT n, n%6 IN (0,2) AS applied, CASE n%6 WHEN 2 THEN 'completed' WHEN 3 THEN 'running' WHEN 4 THEN 'failed' ELSE 'unknown' END AS state, CASE WHEN n%6=3 THEN 'z'||k ELSE '' END AS cell FROM usage")
def f24(spark, d):
    out = when(("n % 6 = 0", F.lit("\n Exit code: 0\nfine")), ("n % 6 = 1", F.lit("Exit code: 1")), ("n % 6 = 2", F.lit("Script completed\nExit code: 1")), ("n % 6 = 3", filled("Script running with cell ID z<k>\nExit code: 0")), ("n % 6 = 4", F.lit("\n\nScript failed")), other=F.lit("")).alias("out")
    u = usage_rows(spark, d).select("n", out)
    return u.select("n", code.exec_applied("out").alias("applied"), code.programmatic_state("out").alias("state"), code.running_cell("out").alias("cell"))


@query("f25_canonical_json", f"""{V} SELECT n, CASE WHEN n%4=0 THEN NULL ELSE '{{"a":[1,{{"x":"é/","y":null}}],"b":'||k||',"c":"'||model||'"}}' END AS canonical FROM usage""")
def f25(spark, d):
    raw = F.when(F.expr("n % 4 = 0"), "{oops").otherwise(filled('{ "c" : "<model>", "b": <k>, "a": [1, {"y": null, "x": "é\\/"}] }'))
    return usage_rows(spark, d).select("n", code.canonical_json(raw).alias("canonical"))


@query("f01_last_component", f"{V} SELECT n, CASE n%4 WHEN 0 THEN project WHEN 1 THEN project WHEN 2 THEN '' ELSE project END AS name, n%3=0 AS unknown FROM usage")
def f01(spark, d):
    path = when(("n % 4 = 0", filled("/a/b/<project>")), ("n % 4 = 1", filled("/a/<project>//")), ("n % 4 = 2", F.lit("/")), other=F.col("project"))
    return usage_rows(spark, d).select("n", X.last_component(path).alias("name"), X.is_unknown(F.when(F.expr("n % 3 = 0"), " UNKNOWN ").otherwise(F.col("model"))).alias("unknown"))


def _state() -> Column:
    return when(("k % 5 = 0", F.lit("live")), ("k % 5 = 1", F.lit("zero")), other=F.lit("stale")).alias("state")


@query("p23_short_series", f"{V} SELECT n, CASE WHEN k%5 IN (0,1) THEN coalesce(CASE WHEN n%3=0 THEN output END/5.0, CAST(input AS DOUBLE)) END AS value FROM usage")
def p23(spark, d):
    u = usage_rows(spark, d).select("n", _state(), F.when(F.expr("n % 3 = 0"), F.col("output")).alias("tokens_5"), F.col("input").cast("double").alias("tps"))
    return u.select("n", curves.short_value().alias("value"))


@query("p24_second_series", f"{V} SELECT n, CASE WHEN k%5 IN (0,1) AND n%3=0 THEN CAST(output AS DOUBLE) END AS value FROM usage")
def p24(spark, d):
    u = usage_rows(spark, d).select("n", _state(), F.when(F.expr("n % 3 = 0"), F.col("output")).alias("tokens_1"))
    return u.select("n", curves.second_value().alias("value"))


@query("p31_bucket_normaliser", f"""{V} SELECT n, greatest(input-500,0) AS input, greatest(k-50,0) AS lines_added, output AS lines_deleted, greatest(k-50,0)-output AS lines_net, CASE WHEN k>3 THEN 'a='||(k-3) ELSE '' END AS counts,
 CASE WHEN k>3 THEN 'a,b' ELSE 'b' END AS skills FROM usage""")  # fmt: skip
def p31(spark, d):
    u = usage_rows(spark, d).withColumns({"input": F.col("input") - 500, "lines_added": F.col("k") - 50, "lines_deleted": F.col("output"), "skill_counts": F.create_map(F.lit(" a "), F.col("k") - 3), "skills": F.array(F.lit("b "), F.lit(""), F.lit("b"))})
    out = usage.normalise_bucket(u)
    return out.select("n", "input", "lines_added", "lines_deleted", "lines_net", X.counts_text("skill_counts").alias("counts"), F.array_join("skills", ",").alias("skills"))


@query("p32_session_normaliser", f"{V} SELECT n, greatest(k-50,0) AS active_seconds, CASE WHEN n%2=0 THEN greatest(input-400,0) ELSE 0 END AS slot, 24 AS slots FROM usage")
def p32(spark, d):
    hours = F.when(F.expr("n % 2 = 0"), F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.when(i == 3, F.col("input") - 400).otherwise(F.lit(-1)))).otherwise(F.array(F.lit(0).cast("long")))
    out = sessions.normalise_session(usage_rows(spark, d).select("n", (F.col("k") - 50).alias("active_seconds"), hours.alias("hour_histogram")))
    return out.select("n", "active_seconds", F.get("hour_histogram", F.lit(3)).alias("slot"), F.size("hour_histogram").alias("slots"))


@query("a28_model_list", f"""{V}, s AS (SELECT ts_ms, n, model, CAST(output AS DOUBLE) AS v, k%5 IN (0,1) AS ok FROM usage), last AS (SELECT arg_max(model,(ts_ms,n)) AS model, arg_max(v,(ts_ms,n)) AS v FROM s WHERE ok)
 SELECT m.model, CASE WHEN m.model=l.model THEN l.v ELSE 0.0 END AS value, row_number() OVER (ORDER BY CASE WHEN m.model=l.model THEN l.v ELSE 0.0 END DESC, m.model) AS place FROM (SELECT DISTINCT model FROM s WHERE ok) m, last l""")  # fmt: skip
def a28(spark, d):
    u = usage_rows(spark, d).select(F.struct("ts_ms", "n").alias("at"), _state(), F.create_map("model", F.col("output").cast("double")).alias("by_model"))
    return curves.model_list(u)


@query("f30_zone_offset", f"{V} SELECT n, '+05:30' AS kolkata, CASE WHEN epoch_us((make_timestamp(ts_us) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')-ts_us=-14400000000 THEN '-04:00' ELSE '-05:00' END AS new_york FROM usage")
def f30(spark, d):
    at = F.timestamp_micros("ts_us")
    return usage_rows(spark, d).select("n", X.zone_offset(at, "Asia/Kolkata").alias("kolkata"), X.zone_offset(at, "America/New_York").alias("new_york"))


@query("m08_rebuild_protocol", f"{V} SELECT hostname, max(k) AS revision, CAST(NULL AS BIGINT) AS rebuild_target, CAST(9 AS BIGINT) AS parser_version, hostname='host1' AS adopted FROM usage GROUP BY 1")
def m08(spark, d):
    """A rebuild begun and completed on each host's state; revisions stay, and one host's name is adopted."""
    state = usage_rows(spark, d).groupBy("hostname").agg(F.max("k").alias("revision")).withColumns({"rebuild_target": F.lit(None).cast("long"), "parser_version": F.lit(3).cast("long"), "adopted": F.lit(False)})
    return incremental.adopt_hostname(incremental.complete_rebuild(incremental.begin_rebuild(state, 9)), "host1")


@query("m06_hostname_gate", f"{V} SELECT hostname, CASE WHEN hostname='host1' THEN 'current' ELSE 'foreign' END AS state, count(*) AS n FROM usage GROUP BY 1")
def m06(spark, d):
    u = usage_rows(spark, d)
    return u.withColumn("state", incremental.hostname_state("hostname", "host1")).groupBy("hostname", "state").agg(F.count("*").alias("n"))


ORACLE["s23_reconcile_report"] = f"""WITH c AS ({ORACLE['j09_reconcile']}), v AS (SELECT hostname, count(*) FILTER (status='mismatch') AS bad, count(*) FILTER (status='missing') AS gone FROM c GROUP BY 1)
 SELECT hostname, 1 AS kind, field, CASE status WHEN 'match' THEN '✓' WHEN 'mismatch' THEN '✗' ELSE '·' END||' '||rpad(field,18,' ')||lpad(coalesce(local,'-'),16,' ')||lpad(coalesce(remote,'-'),16,' ') AS line FROM c
 UNION ALL SELECT hostname, 2, '', hostname||': '||CASE WHEN gone>0 THEN 'no remote figures' WHEN bad>0 THEN bad||' fields differ' ELSE 'all fields agree' END FROM v"""

"""Calls, outputs, skills and edits of rollout files."""

import json

from tallyloom.operators import rollout, rollout_tools

PATCH = "*** Begin Patch\n*** Update File: a.py\n@@\n-x\n+y\n+z\n*** End Patch"


def item(second, **payload):
    return {"type": "response_item", "payload": payload, **({} if second is None else {"timestamp": f"2026-01-05T10:00:{second:02d}Z"})}


def parsed(spark, rows):
    rows = [{"timestamp": "2026-01-05T10:00:00Z", "type": "session_meta", "payload": {"id": "r", "cwd": "/p/proj"}}, {"timestamp": "2026-01-05T10:00:00Z", "type": "turn_context", "payload": {"model": "m", "turn_id": "t"}}, *rows]
    return rollout.parsed(spark.createDataFrame([("f", "codex", k, json.dumps(r)) for k, r in enumerate(rows)], "file_id string, source string, line_no long, raw string"))


def test_edits_need_a_successful_output(spark):
    rows = parsed(spark, [
        item(1, type="custom_tool_call", call_id="ok", name="apply_patch", input=PATCH), item(2, type="custom_tool_call_output", call_id="ok", output="Exit code: 0"),
        item(3, type="custom_tool_call_output", call_id="early", output=[{"type": "input_text", "text": "Success. Updated the following files"}]), item(4, type="function_call", call_id="early", name="shell", arguments=json.dumps({"input": PATCH})),
        item(5, type="custom_tool_call", call_id="bad", name="apply_patch", input=PATCH), item(6, type="custom_tool_call_output", call_id="bad", output="Exit code: 1"),
        item(7, type="custom_tool_call", call_id="none", name="apply_patch", input=PATCH),
        item(None, type="custom_tool_call", call_id="untimed", name="apply_patch", input=PATCH), item(8, type="custom_tool_call_output", call_id="untimed", output="Exit code: 0"),
        item(9, type="custom_tool_call", call_id="js", name="exec", input=f"await tools.apply_patch({json.dumps(PATCH)});"), item(10, type="custom_tool_call_output", call_id="js", output="Script completed\nok"),
        item(11, type="custom_tool_call", call_id="js2", name="exec", input=f"await tools.apply_patch({json.dumps(PATCH)});"), item(12, type="custom_tool_call_output", call_id="js2", output="Script failed\nExit code: 0"),
    ])
    got = sorted((r["tool_use_id"], r["added"], r["deleted"], r["model"], r["project"]) for r in rollout_tools.edit_entries(rows).collect())
    assert got == [(i, 2, 1, "m", "proj") for i in ("early", "js", "ok")]
    assert [r["message"] for r in rollout_tools.skipped_edits(rows).collect()] == ["line 10: edit call skipped (missing timestamp)"]


def test_skills_and_mcp_calls(spark):
    rows = parsed(spark, [
        item(1, type="function_call", call_id="a", name="exec_command", arguments=json.dumps({"cmd": "cat /s/deploy/SKILL.md"})), item(2, type="function_call", call_id="b", name="exec_command", arguments=json.dumps({"cmd": "rg x /s/other/SKILL.md"})),
        item(3, type="message", role="user", content=[{"type": "input_text", "text": "use [$review](x/review/SKILL.md)"}]), item(3, type="message", role="developer", content=[{"text": "[$no](x/SKILL.md)"}]),
        item(4, type="function_call", call_id="d", name="mcp__files__read", arguments="{}"), item(5, type="function_call_output", call_id="d", output="fine"),
        item(6, type="function_call", call_id="e", name="mcp__files__read", arguments="{}"), item(7, type="function_call_output", call_id="e", output='{"isError": true}'),
        item(8, type="function_call", call_id="g", name="mcp__lost__read", arguments="{}"),
        item(9, type="custom_tool_call", call_id="h", name="exec", input="await tools.mcp__git__log({}); await tools.mcp__git__log({});"), item(10, type="custom_tool_call_output", call_id="h", output="Script running with cell ID 7\n"),
        item(11, type="function_call", call_id="w", name="wait", arguments=json.dumps({"cell_id": "7"})), item(12, type="function_call_output", call_id="w", output="Script completed\n"),
        item(13, type="custom_tool_call", call_id="k", name="exec", input="await tools.mcp__slow__x({});"), item(14, type="custom_tool_call_output", call_id="k", output="Script running with cell ID 8"),
    ])
    got = rollout_tools.count_events(rows).collect()
    assert sorted((sorted(r["skill_counts"].items()), sorted(r["mcp_counts"].items())) for r in got) == [([], [("files", 1)]), ([], [("git", 2)]), ([("deploy", 1)], []), ([("review", 1)], [])]
    assert all(r["merge_strategy"] == "cumulativeMax" and r["total"] == 0 and r["model"] == "m" for r in got)

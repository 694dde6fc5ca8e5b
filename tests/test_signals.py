"""Live lines in several dialects."""

import json

from pyspark.sql import functions as F

from tallyloom.operators import signals


def test_fields_of_live_lines(spark):
    rows = [
        {"timestamp": "2026-01-01T00:00:00Z", "type": "event_msg", "payload": {"info": {"last_token_usage": {"output_tokens": 5}, "total_token_usage": {"output_tokens": 50}}}},
        {"ts": 1767225601, "message": {"id": "m1", "model": " x ", "usage": {"output_tokens": "7"}}, "sessionId": "s"},
        {"created_at": "2030-01-01T00:00:00Z", "deep": [{"completionTokens": 9}], "uuid": "u", "message": {}},
        {"type": "turn_context", "payload": {"model": "ctx"}, "usage": {"output_tokens": True}},
        {"type": "session_meta", "payload": {"source": "cli", "model": "late"}, "total_output_tokens": 1e3},
    ]
    lines = spark.createDataFrame([("f", "codex", k, json.dumps(r)) for k, r in enumerate(rows)], "file_id string, source string, line_no long, raw string")
    now = F.timestamp_seconds(F.lit(1_767_225_700))
    got = signals.signals(lines, now).withColumn("top", signals.top_level()).orderBy("line_no").collect()
    assert [r["tokens"] for r in got] == [5, 7, 9, None, None]
    assert [r["total"] for r in got] == [50, None, None, None, 1000]
    assert [r["message"] for r in got] == [None, "s\0m1", "\0u", None, None]
    assert [r["model"] for r in got] == [None, "x", None, "ctx", "late"]
    assert [r["top"] or False for r in got] == [False, False, False, False, True]
    seconds = [r["s"] for r in signals.signals(lines, now).select(F.unix_seconds("at").alias("s"), "line_no").orderBy("line_no").collect()]
    assert seconds == [1_767_225_600, 1_767_225_601, 1_767_225_700, 1_767_225_700, 1_767_225_700]
    assert signals.latest_model(lines).first()["model"] == "ctx"

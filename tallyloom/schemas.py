"""Schemas of the tables and the constants that several operators share."""

from __future__ import annotations

BUCKET_MS = 1_800_000
WINDOW_SECONDS = 180
SHORT_WINDOW_SECONDS = 5
FUTURE_SLACK_SECONDS = 5
STALE_SECONDS = 300
FREEZE_DAYS = 30
EDIT_LINE_CAP = 2000
NAME_CAP = 100
UNKNOWN = "unknown"
MAX_LONG = 2**63 - 1
COUNTS = ["input", "output", "cached_input", "cache_creation", "reasoning"]

LINES = "file_id string, source string, line_no long, raw string"
USAGE_EVENTS = (
    "event_id string, source string, model string, project string, ts_ms long, input long, output long, cached_input long, cache_creation long, "
    "reasoning long, total long, session_hash string, file_id string, rollout_key string, parent_rollout_key string, inherited boolean, "
    "has_total_snapshot boolean, lineage_fingerprint string, dedup_key string, merge_strategy string, skill_counts map<string,long>, "
    "mcp_counts map<string,long>, hostname string"
)
SESSION_EVENTS = "event_id string, source string, session_hash string, role string, ts_ms long, file_id string, hostname string"
EDIT_ENTRIES = "tool_use_id string, source string, model string, project string, ts_ms long, added long, deleted long, file_id string, hostname string"
FILES = "file_id string, source string, path_hash string, offset long, size long, mtime_ms long, parser_version int, status string"
LIVE_RATE = (
    "ts timestamp, state string, tps double, tokens_180 double, tokens_5 double, tokens_1 double, model_180 map<string,double>, "
    "model_5 map<string,double>, model_1 map<string,double>, latest_signal timestamp"
)

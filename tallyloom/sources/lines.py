"""Readers: log lines with their numbers, saved API answers, process tables, PID registries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.exprs import coerce_long, parse_time, total_of
from tallyloom.schemas import COUNTS

RESERVED_SOURCES = {"codex", "claude", "cliproxy", "unknown"}
MOST_API_BYTES = 128 << 20


def read_lines(spark: SparkSession, root: str, source: str) -> DataFrame:
    """``(file_id, source, line_no, raw)`` of every ``.jsonl`` file below the root, without empty lines; line numbers count from 0.

    A root that doesn't exist has no lines; hidden files and folders below it are left out. Files are split and read line by line, so a file may be of
    any size. A split numbers its own lines, and the counts of a file's earlier splits are added.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "file_id string, source string, line_no long, raw string")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("lineSep", "\n").text(root)
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9+.-]+:/*|^/*", "/")
    below = F.substring(bare(F.col("_metadata.file_path")), len(re.sub("^[a-z0-9+.-]+:/*|^/*", "/", root.rstrip("/"))) + 1, 1 << 20)
    lines = files.where(~below.rlike(r"/\.")).select(
        F.sha2(F.col("_metadata.file_path"), 256).alias("file_id"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("raw")
    )
    # a split is read by one task, in order, without a gap in its ids
    splits = lines.groupBy("file_id", "begin").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file_id").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file_id", "begin", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = lines.join(splits, ["file_id", "begin"]).where(F.trim("raw") != "")
    return numbered.select("file_id", F.lit(source).alias("source"), (F.col("at") + F.col("shift")).alias("line_no"), "raw")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, file_id, size, mtime_ms)`` without reading any content."""
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    return meta.select("path", F.sha2("path", 256).alias("file_id"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))


def subagent_file(path: str = "path"):
    return F.col(path).rlike(r"/subagents/agent-[^/]*\.jsonl$")


def split_dialects(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rollout lines, transcript lines)."""
    return lines.where("source = 'codex'"), lines.where("source <> 'codex'")


def invalid_lines(lines: DataFrame) -> DataFrame:
    """A diagnostic for each line that isn't a JSON object."""
    bad = F.try_parse_json("raw").isNull() | ~F.trim("raw").startswith("{")
    return lines.where(bad).select("file_id", "line_no", F.concat(F.lit("line "), (F.col("line_no") + 1).cast("string"), F.lit(": invalid json")).alias("message"))


def source_name(name: str) -> str:
    """A declared source's name: lower case, letters, digits, dot, dash and underscore, 30 at most."""
    clean = re.sub(r"[^a-z0-9._-]", "-", name.strip().lower())[:30].strip("-")
    if not clean or clean in RESERVED_SOURCES:
        raise ValueError(f"source name {name!r} can't be used")
    return clean


def check_roots(declared: dict[str, str]) -> dict[str, str]:
    """Declared sources by clean name; roots are absolute and don't lie in each other."""
    out: dict[str, str] = {}
    for name, root in declared.items():
        clean, root = source_name(name), root.rstrip("/") or "/"
        if not root.startswith("/"):
            raise ValueError(f"{root!r} is not an absolute path")
        for other, taken in out.items():
            if clean == other or f"{root}/".startswith(f"{taken}/") or f"{taken}/".startswith(f"{root}/"):
                raise ValueError(f"{name!r} overlaps {other!r}")
        out[clean] = root
    return out


API = "apis map<string,struct<models:map<string,struct<details:array<struct<timestamp:string,api_key_hash:string,resolved_model:string,tokens:struct<input_tokens:bigint,output_tokens:bigint,reasoning_tokens:bigint,cached_tokens:bigint,cache_tokens:bigint,cache_read_tokens:bigint,cache_creation_tokens:bigint,total_tokens:bigint>>>>>>>"


def read_api_usage(spark: SparkSession, path: str, api_key: str) -> DataFrame:
    """Usage events of one key from a saved answer: endpoints, models and details unnested; rows without tokens and repeated ids dropped."""
    size = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    if size > MOST_API_BYTES:
        raise ValueError(f"the answer has {size} bytes; {MOST_API_BYTES} are the most")
    return api_events(spark.read.text(path, wholetext=True).select(F.from_json("value", API).alias("a")), api_key)


def api_events(answers: DataFrame, api_key: str) -> DataFrame:
    """``answers``: column a of the API schema."""
    models = answers.select(F.explode("a.apis").alias("endpoint", "e")).select("endpoint", F.explode("e.models").alias("model_key", "m"))
    d = models.select("endpoint", "model_key", F.explode("m.details").alias("d")).where(F.col("d.api_key_hash") == F.sha2(F.lit(api_key), 256))
    n = lambda c: F.greatest(F.coalesce(F.col(f"d.tokens.{c}"), F.lit(0)), F.lit(0))
    hit = F.least(n("input_tokens"), F.greatest(n("cached_tokens"), n("cache_tokens"), n("cache_read_tokens")))
    made = F.least(F.greatest(n("input_tokens") - hit, F.lit(0)), n("cache_creation_tokens"))
    think = F.least(n("output_tokens"), n("reasoning_tokens"))
    out = d.select(
        F.coalesce(F.nullif(F.trim("d.resolved_model"), F.lit("")), "model_key").alias("model"), F.unix_millis(parse_time("d.timestamp")).alias("ts_ms"), (n("input_tokens") - hit - made).alias("input"), (n("output_tokens") - think).alias("output"),
        hit.alias("cached_input"), made.alias("cache_creation"), think.alias("reasoning"), n("total_tokens").alias("reported"), F.sha2(F.concat_ws("|", "endpoint", "model_key", "d.timestamp", F.to_json("d.tokens")), 256).alias("event_id"),
    )
    out = out.where(F.col("ts_ms").isNotNull()).withColumn("total", total_of("reported")).where("total > 0").drop("reported")
    return out.dropDuplicates(["event_id"]).select("event_id", F.lit("cliproxy").alias("source"), "model", F.lit("unknown").alias("project"), "ts_ms", *COUNTS, "total")


def read_processes(lines: DataFrame, text: str = "value") -> DataFrame:
    """``(pid, rss_bytes, cpu, path)`` of a saved process table; a path may have spaces; rows without a pid are dropped, bad cells null."""
    part = lambda k: F.regexp_extract(text, r"^\s*(\d+)\s+(\S+)\s+(\S+)\s+(\S.*?)\s*$", k)
    number = lambda c: F.when(c.rlike(r"^\d{1,15}(\.\d+)?$"), c).cast("double")
    return lines.where(part(1) != "").select(part(1).cast("long").alias("pid"), (number(part(2)) * 1024).cast("long").alias("rss_bytes"), number(part(3)).alias("cpu"), part(4).alias("path"))


REGISTRY = "pid long, sessionId string, kind string, entrypoint string, status string"


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    """Registered sessions: ``<pid>.json`` files."""
    rows = spark.read.schema(REGISTRY).option("multiLine", "true").json(root).withColumn("file", F.col("_metadata.file_name"))
    return rows.select("pid", F.regexp_extract("file", r"^(\d+)\.json$", 1).cast("long").alias("file_pid"), F.col("sessionId").alias("session"), "kind", "entrypoint", "status")


def variant_long(column: str, path: str):
    return coerce_long(F.col(column), path)


REMOTE = "hostname string, buckets long, input long, output long, cached_input long, cache_creation long, reasoning long, upstream_total long, first_bucket_ms long, last_bucket_ms long"


def read_remote_totals(spark: SparkSession, path: str) -> DataFrame:
    """The other side's control totals, one JSON object per host; what ``operators.usage.reconcile`` compares with."""
    return spark.read.schema(REMOTE).option("multiLine", "true").json(path).where(F.col("hostname").isNotNull())

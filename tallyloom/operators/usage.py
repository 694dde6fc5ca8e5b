"""Buckets, edit lines, summaries, costs and comparisons over deduplicated usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.exprs import bucket_start, cap_lines, cost, micros, names_with_keys, normalise_counts, saturating_sum, share_or_null, upstream_basis, window_bounds
from tallyloom.schemas import BUCKET_MS, COUNTS

BUCKET_KEY = ["source", "model", "project", "bucket_start_ms"]
# Fixed value: what a model costs that no pattern matches (USD per million: input, output, cache read, reasoning).
FALLBACK_PRICE = (3.0, 15.0, 0.3, 0.0)


def bucket_tokens(events: DataFrame, keys: list[str] | None = None, width_ms: int = BUCKET_MS) -> DataFrame:
    """Token sums by half-hour bucket. Partial sums are made before the shuffle."""
    keys = keys or ["source", "model", "project"]
    return events.groupBy(*keys, bucket_start("ts_ms", width_ms).alias("bucket_start_ms")).agg(*[saturating_sum(c).alias(c) for c in [*COUNTS, "total"]])


def sum_map(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Map column summed by key. Entries are exploded, so no group of any size is collected before it is aggregated."""
    each = rows.select(*keys, F.explode(column).alias("__k", "__v")).groupBy(*keys, "__k").agg(saturating_sum("__v").alias("__v"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__v")))).alias(column))


def edit_buckets(edits: DataFrame) -> DataFrame:
    """Added, deleted and net lines by bucket; edits beyond the cap count as none. ``edits`` are deduplicated."""
    capped = edits.withColumn("c", cap_lines("added", "deleted"))
    out = capped.groupBy("source", "model", "project", bucket_start("ts_ms").alias("bucket_start_ms")).agg(saturating_sum("c.added").alias("lines_added"), saturating_sum("c.deleted").alias("lines_deleted"))
    return out.withColumn("lines_net", F.col("lines_added") - F.col("lines_deleted"))


def normalise_bucket(rows: DataFrame) -> DataFrame:
    """Counts not below zero, net lines from the others, maps normalised, skills the sorted union of the list and the map's keys. Null counts are zero."""
    numbers = [c for c in [*COUNTS, "total", "lines_added", "lines_deleted"] if c in rows.columns]
    out = rows.withColumns({c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long") for c in numbers})
    out = out.withColumns({c: normalise_counts(c) for c in ("skill_counts", "mcp_counts") if c in rows.columns})
    if {"lines_added", "lines_deleted"} <= set(numbers):
        out = out.withColumn("lines_net", F.col("lines_added") - F.col("lines_deleted"))
    return out.withColumn("skills", names_with_keys(F.col("skills"), F.col("skill_counts"))) if {"skills", "skill_counts"} <= set(rows.columns) else out


def buckets_with_edits(tokens: DataFrame, edits: DataFrame, measured: DataFrame) -> DataFrame:
    """Token and edit buckets together; buckets of edits alone appear with zero tokens. Sources in ``measured`` have code metric version 2.

    Two pre-aggregates are stacked and summed, which costs less than a full join.
    """
    numbers = [*COUNTS, "total", "lines_added", "lines_deleted", "lines_net"]
    both = tokens.unionByName(edits.withColumn("has_edits", F.lit(True)), allowMissingColumns=True)
    out = both.groupBy(*BUCKET_KEY).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce(F.bool_or("has_edits"), F.lit(False)).alias("has_edits"))
    known = measured.select("source").distinct().withColumn("measured", F.lit(True))
    version = F.when(F.col("measured") | F.col("has_edits"), 2).otherwise(0)
    return out.join(known, "source", "left").withColumn("code_metric_version", version.cast("int")).drop("measured", "has_edits")


def output_buckets(buckets: DataFrame, start_ms: int | Column, end_ms: int | Column, by_model: bool = False) -> DataFrame:
    keys = ["bucket_start_ms", *(["model"] if by_model else [])]
    inside = (F.col("bucket_start_ms") >= start_ms) & (F.col("bucket_start_ms") < end_ms)
    return buckets.where(inside).groupBy(*keys).agg(saturating_sum("output").alias("output"))


def prices_for(models: DataFrame, prices: DataFrame) -> DataFrame:
    """``(model, price)``: the longest pattern that the lower-cased model contains; ``prices`` has rank, pattern and four prices.

    Patterns of one length go by rank. Only distinct models meet the price list, which is a table of some dozens of rows.
    """
    names = models.select("model").distinct()
    fields = ["input_price", "output_price", "cache_price", "reasoning_price"]
    hit = F.lower("model").contains(F.lower("pattern"))
    best = names.join(F.broadcast(prices.where("pattern <> ''")), hit, "left").groupBy("model").agg(
        F.min_by(F.struct(*fields), F.when(F.col("pattern").isNotNull(), F.struct(-F.length("pattern"), "rank"))).alias("price")
    )
    fallback = F.struct(*[F.lit(x).cast("double").alias(f) for f, x in zip(fields, FALLBACK_PRICE)])
    return best.select("model", F.coalesce("price", fallback).alias("price"))


def with_cost(buckets: DataFrame, prices: DataFrame) -> DataFrame:
    """``cost`` of each bucket; a null model costs what no pattern matches."""
    found = prices_for(buckets, prices).withColumnRenamed("model", "__model")
    return buckets.join(found, F.col("model").eqNullSafe(F.col("__model"))).drop("__model").withColumn("cost", cost("input", "output", "cached_input", "reasoning", F.col("price"))).drop("price")


def in_window(buckets: DataFrame, window: str, ref: Column, zone: str = "UTC", hostname: str | None = None) -> DataFrame:
    """Buckets whose start lies in [start, end) of the window; ``ref``: an instant, as a literal or from the rows."""
    out = buckets if hostname is None else buckets.where(F.col("hostname") == hostname)
    bounds = window_bounds(window, ref, zone)
    if bounds is None:
        return out
    at = F.col("bucket_start_ms") * 1000
    return out.where((at >= micros(bounds[0])) & (at < micros(bounds[1])))


def summary(costed: DataFrame) -> DataFrame:
    """Totals, or no row where there is no bucket."""
    out = costed.agg(F.count("*").alias("buckets"), *[saturating_sum(c).alias(c) for c in [*COUNTS, "total"]], F.sum("cost").alias("cost"))
    return out.where("buckets > 0")


def model_summary(costed: DataFrame, *more: str) -> DataFrame:
    return costed.groupBy(*more, "model").agg(*[saturating_sum(c).alias(c) for c in [*COUNTS, "total"]], F.sum("cost").alias("cost"))


def all_windows(costed: DataFrame, ref: Column, zone: str = "UTC") -> DataFrame:
    """Day, week, month and all, in total (model null) and per model, from one scan."""
    at = F.col("bucket_start_ms") * 1000
    member = []
    for w in ("day", "week", "month", "all"):
        b = window_bounds(w, ref, zone)
        member.append(F.when(F.lit(True) if b is None else (at >= micros(b[0])) & (at < micros(b[1])), F.lit(w)))
    rows = costed.withColumn("window", F.explode(F.array_compact(F.array(*member))))
    aggs = [saturating_sum(c).alias(c) for c in [*COUNTS, "total"]] + [F.sum("cost").alias("cost")]
    return rows.groupingSets([["window"], ["window", "model"]], "window", "model").agg(*aggs)


def cache_rate(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cache_rate", share_or_null("cached_input", F.col("cached_input") + F.col("input")))


def top_models(models: DataFrame, most: int = 3) -> DataFrame:
    """The largest models with their share of all tokens and how many are left out. ``models`` has a row per model."""
    some = models.where("total > 0")
    sums = some.agg(F.sum("total").alias("all_tokens"), F.count("*").alias("n"))
    best = some.select("model", "total").orderBy(F.desc("total"), "model").limit(most)
    hidden = F.greatest(F.col("n") - most, F.lit(0)).cast("long")
    return best.crossJoin(F.broadcast(sums)).select("model", "total", share_or_null("total", "all_tokens").alias("share"), hidden.alias("hidden"))


def anchored(real: DataFrame, target: DataFrame, anchor: DataFrame, residual: str = "other") -> DataFrame:
    """``(model, total)``: target + (real - anchor) for each model, never below zero; the residual row takes up what is lost by that.

    Both tables are the caller's. Figures made so are for display; they are not measurements.
    """
    t, a, r = (d.select("model", F.col("total").alias(n)) for d, n in ((target, "t"), (anchor, "a"), (real, "r")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    all_ = r.join(t, "model", "full").join(a, "model", "full").select("model", (zero("t") + zero("r") - zero("a")).alias("want"))
    shown = all_.select("model", F.greatest("want", F.lit(0)).alias("total"))
    gap = all_.agg(F.coalesce(F.sum(F.least("want", F.lit(0))), F.lit(0)).cast("long").alias("total")).select(F.lit(residual).alias("model"), "total")
    return shown.unionByName(gap).groupBy("model").agg(F.greatest(F.sum("total"), F.lit(0)).cast("long").alias("total")).where("total > 0")


def host_totals(buckets: DataFrame) -> DataFrame:
    """Control totals of each host."""
    return buckets.groupBy("hostname").agg(
        F.count("*").alias("buckets"), *[saturating_sum(c).alias(c) for c in [*COUNTS, "total"]], saturating_sum(upstream_basis("total", "cache_creation")).alias("upstream_total"),
        F.min("bucket_start_ms").alias("first_bucket_ms"), F.max("bucket_start_ms").alias("last_bucket_ms"),
    )


RECONCILED = ["buckets", *COUNTS, "upstream_total", "first_bucket_ms", "last_bucket_ms"]


def reconcile(local: DataFrame, remote: DataFrame, fields: list[str] = RECONCILED) -> DataFrame:
    """Field by field comparison in long form: hostname, field, local, remote, status (match, mismatch or missing)."""
    r = remote.select("hostname", F.lit(True).alias("there"), *[F.col(f).alias(f"r_{f}") for f in fields])
    both = local.join(r, "hostname", "left")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias("local"), F.col(f"r_{f}").cast("long").alias("remote")) for f in fields])
    status = F.when(F.col("there").isNull(), "missing").when(F.col("x.local").eqNullSafe(F.col("x.remote")), "match").otherwise("mismatch")
    return both.select("hostname", "there", F.explode(each).alias("x")).select("hostname", "x.field", "x.local", "x.remote", status.alias("status"))


def reconcile_report(compared: DataFrame) -> DataFrame:
    """A line of text per field and a verdict per host."""
    mark = F.when(F.col("status") == "match", "✓").when(F.col("status") == "mismatch", "✗").otherwise("·")
    text = lambda c: F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), 16, " ")
    lines = compared.select("hostname", F.lit(1).alias("kind"), "field", F.concat(mark, F.lit(" "), F.rpad("field", 18, " "), text("local"), text("remote")).alias("line"))
    verdict = compared.groupBy("hostname").agg(F.count_if(F.col("status") == "mismatch").alias("bad"), F.count_if(F.col("status") == "missing").alias("gone"))
    said = F.when(F.col("gone") > 0, "no remote figures").when(F.col("bad") > 0, F.format_string("%d fields differ", "bad")).otherwise("all fields agree")
    return lines.unionByName(verdict.select("hostname", F.lit(2).alias("kind"), F.lit("").alias("field"), F.concat("hostname", F.lit(": "), said).alias("line")))


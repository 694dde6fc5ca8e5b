"""Replay-safe merging of raw rows: upserts, copies of files, replayed history, identical content.

"First" always means first by (ts_ms, event_id, file_id); rows have no other order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.exprs import col, component_sum, is_unknown, total_of
from tallyloom.schemas import COUNTS, UNKNOWN

ORDER = ["ts_ms", "event_id", "file_id"]


def order_key(columns: list[str] = ORDER) -> Column:
    return F.struct(*columns)


def first_known_model(order: Column | None = None) -> Column:
    """The first model that is known, else unknown; min_by skips rows whose key is null."""
    order = order if order is not None else order_key()
    return F.coalesce(F.min_by("model", F.when(~is_unknown("model"), order)), F.lit(UNKNOWN))


def map_max(column: str) -> Column:
    """Key-wise largest values over a group's maps. Only distinct maps are collected, and before the shuffle: copies of one event hardly differ."""
    entries = F.flatten(F.collect_set(F.map_entries(column)))
    keys = lambda e: F.array_sort(F.array_distinct(F.transform(e, lambda x: x["key"])))
    most = lambda e, k: F.array_max(F.transform(F.filter(e, lambda x: x["key"] == k), lambda x: x["value"]))
    return F.transform(F.array(entries), lambda e: F.map_from_arrays(keys(e), F.transform(keys(e), lambda k: most(e, k))))[0]


def merge_upserts(raw: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per (file_id, event_id): the latest row where its merge strategy is overwrite, else the largest of every count.

    With ``cumulativeMax`` a known model is kept when later rows don't know it.
    """
    latest = F.max_by(F.struct(*[c for c in raw.columns if c not in ("file_id", "event_id", seq)]), seq)
    found = raw.groupBy("file_id", "event_id").agg(
        latest.alias("last"),
        *[F.max(c).alias(f"max_{c}") for c in [*COUNTS, "total"]],
        F.coalesce(F.max_by("model", F.when(~is_unknown("model"), F.col(seq))), F.lit(UNKNOWN)).alias("known_model"),
    )
    cumulative = F.col("last.merge_strategy") == "cumulativeMax"
    pick = {c: F.when(cumulative, F.col(f"max_{c}")).otherwise(F.col(f"last.{c}")) for c in [*COUNTS, "total"]}
    pick["model"] = F.when(cumulative, F.col("known_model")).otherwise(F.col("last.model"))
    return found.select("file_id", "event_id", *[pick.get(c, F.col(f"last.{c}")).alias(c) for c in raw.columns if c not in ("file_id", "event_id", seq)])


def with_tier(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``tier``: 2 for rows of a file that is still there, 1 for rows of a known file that is gone, 0 for rows without a file."""
    status = files.select("file_id", F.col("status").alias("__status"))
    tier = F.when(F.coalesce(F.col("file_id"), F.lit("")) == "", 0).when(F.col("__status").isNotNull() & (F.col("__status") != "missing"), 2).otherwise(1)
    return rows.join(status, "file_id", "left").withColumn("tier", tier).drop("__status")


def best_tier(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the highest tier that their key has. The aggregate combines before the shuffle, so hot keys stay cheap."""
    top = rows.groupBy(*keys).agg(F.max("tier").alias("__top"))
    return rows.join(top, keys).where("tier = __top").drop("__top")


def tier_dedup(rows: DataFrame, keys: tuple[str, ...] = ("source", "event_id")) -> DataFrame:
    """One row per logical event: only its highest tier counts; there, largest counts, first known model, and the rest from the first row.

    Flags merge too: inherited only if all copies are, a complete snapshot if any has one, the first lineage that is not empty.
    """
    own = ["input", "output", "cached_input", "cache_creation", "reasoning"]
    special = {*own, *keys, "tier", "total", "model", "inherited", "has_total_snapshot", "lineage_fingerprint", "dedup_key", "skill_counts", "mcp_counts"}
    rest = [c for c in rows.columns if c not in special]
    order = order_key([c for c in ORDER if c in rows.columns])
    aggs = [F.max(c).alias(c) for c in own if c in rows.columns]
    if "total" in rows.columns:
        aggs.append(F.max("total").alias("__total"))
    if "model" in rows.columns:
        aggs.append(first_known_model(order).alias("model"))
    for c, f in (("inherited", F.bool_and), ("has_total_snapshot", F.bool_or)):
        if c in rows.columns:
            aggs.append(f(c).alias(c))
    for c in ("lineage_fingerprint", "dedup_key"):
        if c in rows.columns:
            aggs.append(F.coalesce(F.min_by(c, F.when(F.col(c) != "", order)), F.lit("")).alias(c))
    aggs += [map_max(c).alias(c) for c in ("skill_counts", "mcp_counts") if c in rows.columns]
    # one row per key and tier first, so that the highest tier is taken among three rows at most and no full row meets another
    tiers = rows.groupBy(*keys, "tier").agg(*aggs, F.min_by(F.struct(*rest), order).alias("__first"))
    own_columns = [c for c in tiers.columns if c not in keys]
    found = tiers.groupBy(*keys).agg(F.max_by(F.struct(*own_columns), "tier").alias("__top")).select(*keys, "__top.*")
    kept = [F.col(c) for c in found.columns if not c.startswith("__")]
    if "__total" in found.columns:
        kept.append(total_of("__total").alias("total"))
    return found.select(*kept, *[F.col(f"__first.{c}").alias(c) for c in rest])


def overwrite_conflicts(rows: DataFrame) -> DataFrame:
    """Events whose copies in the winning tier disagree on who they belong to; reporting waits while there is one.

    Sessions and known models must agree; projects must agree with the first row's, unless that is unknown.
    """
    rows = rows.where("merge_strategy <> 'cumulativeMax'")
    first = F.min_by("project", order_key())
    known = F.when(~is_unknown("model"), F.col("model"))
    # counted for each tier, so the highest one is taken among three rows at most and no full row meets another
    tiers = rows.groupBy("source", "event_id", "tier").agg(
        F.count_distinct("session_hash").alias("sessions"), F.count_distinct(known).alias("models"), F.count_distinct("project").alias("projects"), first.alias("first_project"),
    )
    found = tiers.groupBy("source", "event_id").agg(F.max_by(F.struct("sessions", "models", "projects", "first_project"), "tier").alias("top")).select("source", "event_id", "top.*")
    return found.where((F.col("sessions") > 1) | (F.col("models") > 1) | ((F.col("projects") > 1) & ~is_unknown("first_project"))).select("source", "event_id", "sessions", "models", "projects")


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. min_by over a struct combines before the shuffle, which a ranking window does not."""
    named = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), named).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*rows.columns)


def edit_dedup(edits: DataFrame) -> DataFrame:
    """One row per tool use over all sources: highest tier, then first."""
    return first_by(edits, ["tool_use_id"], [-F.col("tier"), F.col("ts_ms"), F.col("file_id")])


def session_event_dedup(events: DataFrame) -> DataFrame:
    """One row per (source, event_id): highest tier, then first file."""
    return first_by(events, ["source", "event_id"], [-F.col("tier"), F.col("file_id"), F.col("ts_ms")])


def _fold(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows with the same non-empty key become the first of ``order``, with the largest of each map."""
    single = rows.where(F.coalesce(F.col(key), F.lit("")) == "").withColumn("copies", F.lit(1).cast("long"))
    named = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])
    maps = [c for c in ("skill_counts", "mcp_counts") if c in rows.columns]
    rest = [c for c in rows.columns if c not in (key, *maps)]
    groups = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(
        F.min_by(F.struct(*rest), named).alias("__r"), F.count("*").alias("copies"), *[map_max(c).alias(c) for c in maps]
    )
    return groups.select(key, *maps, "copies", *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*single.columns).unionByName(single)


def lineage_fold(rows: DataFrame) -> DataFrame:
    """Replays of one lineage fingerprint count once; a row that isn't inherited is preferred. ``copies`` tells how many were folded."""
    return _fold(rows, "lineage_fingerprint", [F.col("inherited").cast("int"), *[F.col(c) for c in ORDER]])


def content_fold(rows: DataFrame) -> DataFrame:
    """Copies with one content key count once, the one with most billable tokens, then the first. Comes after the lineage fold."""
    rows = rows.drop("copies")
    return _fold(rows, "dedup_key", [-component_sum(), *[F.col(c) for c in ORDER]])


def unprovable_inherited(rows: DataFrame) -> DataFrame:
    """Inherited rows that have no fingerprint: counted for information, never dropped."""
    return rows.where(F.col("inherited") & (F.coalesce(F.col("lineage_fingerprint"), F.lit("")) == "")).agg(F.count("*").alias("rows"))


def duplicate_keys(rows: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Natural keys that occur more than once; a batch may only be sent if there are none."""
    return rows.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("copies")).where("copies > 1")


def occurrence_ids(rows: DataFrame, scope: str, base: str, order: str) -> DataFrame:
    """``event_id``: the base id, from its second occurrence in the scope on with ``#n``."""
    n = F.row_number().over(Window.partitionBy(scope, base).orderBy(order)) - 1
    return rows.withColumn("occurrence", n).withColumn("event_id", F.when(n == 0, F.col(base)).otherwise(F.concat(base, F.lit("#"), n.cast("string"))))

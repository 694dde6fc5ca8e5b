"""Revisions, paging, acknowledgement, retention and freezing of derived rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallyloom.schemas import BUCKET_MS, FREEZE_DAYS


def diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``keys, change``: insert, update, unchanged or delete, with the new values and the old revisions."""
    o = old.select(*keys, *[F.col(v).alias(f"o_{v}") for v in values], "revision", "synced_revision", F.lit(True).alias("o_there"))
    n = new.select(*keys, *values, F.lit(True).alias("n_there"))
    both = n.join(o, keys, "full")
    same = reduce(lambda a, b: a & b, (F.col(v).eqNullSafe(F.col(f"o_{v}")) for v in values))
    change = F.when(F.col("o_there").isNull(), "insert").when(F.col("n_there").isNull(), "delete").when(same, "unchanged").otherwise("update")
    return both.withColumn("change", change).select(*keys, *values, "change", "revision", "synced_revision")


def apply_diff(changes: DataFrame, new_revision: int | Column) -> DataFrame:
    """The derived rows after the diff: changed rows get the new revision, new ones have synced nothing, deleted ones are gone."""
    rev = F.lit(new_revision).cast("long") if isinstance(new_revision, int) else new_revision
    bumped = F.col("change").isin("insert", "update")
    return changes.where("change <> 'delete'").withColumns(
        {"revision": F.when(bumped, rev).otherwise(F.col("revision")), "synced_revision": F.coalesce("synced_revision", F.lit(0).cast("long"))}
    ).drop("change")


def recompute(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], last_revision: int, frozen_ms: int | None = None, at: str = "bucket_start_ms") -> tuple[DataFrame, DataFrame]:
    """(derived rows, changes). Rows before the freeze line keep what they are, on both sides; with nothing changed every revision stays."""
    if frozen_ms is not None:
        kept, old, new = old.where(F.col(at) < frozen_ms), old.where(F.col(at) >= frozen_ms), new.where(F.col(at) >= frozen_ms)
    changes = diff(old, new, keys, values)
    out = apply_diff(changes, last_revision + 1).select(*keys, *values, "revision", "synced_revision")
    if frozen_ms is not None:
        out = out.unionByName(kept.select(*out.columns))
    return out, changes


def pending(rows: DataFrame, order: list[str], most: int, at: str | None = None) -> DataFrame:
    """The first ``most`` rows that haven't been synced, and ``has_more`` on each. One more row than asked for is read."""
    open_ = rows.where(F.col("revision") > F.col("synced_revision"))
    if at is not None:
        open_ = open_.where(F.col(at) >= 0)
    page = open_.orderBy("revision", *order).limit(most + 1)
    n = F.row_number().over(Window.orderBy("revision", *order))  # at most one page and a row
    return page.withColumns({"n": n, "all": F.count("*").over(Window.partitionBy(F.lit(1)))}).where(F.col("n") <= most).withColumn("has_more", F.col("all") > most).drop("n", "all")


def acknowledge(rows: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows sent and unchanged since (same key and revision) are synced; a row with a newer revision stays open."""
    s = sent.select(*keys, F.col("revision").alias("sent_revision")).distinct()
    hit = F.col("revision") == F.col("sent_revision")
    return rows.join(s, keys, "left").withColumn("synced_revision", F.when(hit, F.greatest("synced_revision", "revision")).otherwise(F.col("synced_revision"))).drop("sent_revision")


def high_watermarks(*tables: DataFrame) -> DataFrame:
    """Highest revision of each host over several tables."""
    all_ = reduce(lambda a, b: a.unionByName(b), (t.select("hostname", "revision") for t in tables))
    return all_.groupBy("hostname").agg(F.max("revision").alias("revision"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``order`` and ``row_no``, the row's number from 0 in that order. Rows are dealt into ranges, and a range begins where the counts of those before it end."""
    dealt = rows.select(*order).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    inside = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    # a row per range: as many as there are shuffle partitions
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return inside.join(F.broadcast(starts), "__part").select(*order, (F.col("__start") + F.col("__at")).alias("row_no"))


def batches(buckets: DataFrame, sessions: DataFrame, bucket_order: list[str], session_order: list[str], bucket_cap: int = 500, session_cap: int = 1000) -> DataFrame:
    """``(batch, buckets, sessions)``: sizes of the batches when both kinds are cut by their caps (1 to 2000) and zipped by number."""
    cut = lambda df, order, cap: numbered(df, order).select(F.floor(F.col("row_no") / min(max(cap, 1), 2000)).cast("long").alias("batch"))
    b = cut(buckets, bucket_order, bucket_cap).groupBy("batch").agg(F.count("*").alias("buckets"))
    s = cut(sessions, session_order, session_cap).groupBy("batch").agg(F.count("*").alias("sessions"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return b.join(s, "batch", "full").select("batch", zero("buckets"), zero("sessions"))


# -- files and freezing --------------------------------------------------------------------------


def missing_files(files: DataFrame, present: DataFrame, source: str) -> DataFrame:
    """Checkpoints of the source whose file isn't there any more."""
    return files.where((F.col("source") == source) & (F.col("status") != "missing")).join(present, "file_id", "left_anti")


def mark_missing(files: DataFrame, present: DataFrame, source: str) -> DataFrame:
    there = present.select("file_id", F.lit(True).alias("there")).distinct()
    gone = (F.col("source") == source) & F.col("there").isNull()
    return files.join(there, "file_id", "left").withColumn("status", F.when(gone, "missing").otherwise(F.col("status"))).drop("there")


def changed_files(listing: DataFrame, manifest: DataFrame, parser_version: int) -> DataFrame:
    """Listed files to read: all but those whose complete checkpoint has the same size, time and parser version."""
    known = manifest.where((F.col("status") == "complete") & (F.col("parser_version") == parser_version)).select("file_id", F.col("size").alias("k_size"), F.col("mtime_ms").alias("k_mtime"))
    same = (listing["file_id"] == known["file_id"]) & (F.col("size") == F.col("k_size")) & (F.abs(F.col("mtime_ms") - F.col("k_mtime")) < 1)
    return listing.join(known, same, "left_anti")


def candidate_files(listing: DataFrame, now_ms: int, most: int = 96, age_ms: int = 900_000) -> DataFrame:
    """Recent files that aren't empty: newest first, then by path."""
    return listing.where((F.col("size") > 0) & (F.col("mtime_ms") >= now_ms - age_ms)).orderBy(F.desc("mtime_ms"), "path").limit(most)


def rebuild_reasons(files: DataFrame, raw: DataFrame, parser_version: int) -> DataFrame:
    """Why the raw rows have to be parsed anew: an older parser, or negative times in a file that is there. Each is a probe of one row."""
    old = files.where((F.col("status") != "missing") & (F.col("parser_version") != parser_version)).limit(1).select(F.lit("parser_version").alias("reason"))
    there = files.where("status <> 'missing'").select("file_id")
    bad = raw.where("ts_ms < 0").join(there, "file_id", "left_semi").limit(1).select(F.lit("negative_timestamp").alias("reason"))
    return old.unionByName(bad)


def frozen_target(now_ms: int | Column, days: int = FREEZE_DAYS) -> Column:
    """The half hour that lies ``days`` before now."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return F.floor((now - days * 86_400_000) / BUCKET_MS).cast("long") * BUCKET_MS


def advance_frozen(current_ms: int, now_ms: int, files: DataFrame, derivation_pending: bool, days: int = FREEZE_DAYS) -> int:
    """The new freeze line: never back, and not while a file is degraded or rows wait to be derived."""
    target = (now_ms - days * 86_400_000) // BUCKET_MS * BUCKET_MS
    if derivation_pending or target <= current_ms or not files.where("status = 'degraded'").isEmpty():
        return current_ms
    return target


def drop_late(rows: DataFrame, frozen_ms: int | Column) -> tuple[DataFrame, DataFrame]:
    """(rows kept, count of those that come too late)."""
    late = F.col("ts_ms") < frozen_ms
    return rows.where(~late), rows.where(late).agg(F.count("*").alias("late"))


def drop_late_observed(rows: DataFrame, frozen_ms: int, name: str = "late", future_ms: int | None = None) -> tuple[DataFrame, Observation | None]:
    """Rows that come in time, and what counts the others while they are read: one scan. The counts (``late``, ``future``, ``kept``) are there once an action has run.

    Rows from ``future_ms`` on are dropped as well. On a stream the counts come with each batch's progress under ``name``, and there is no observation to ask.
    """
    late = F.col("ts_ms") < frozen_ms
    ahead = F.lit(False) if future_ms is None else F.col("ts_ms") >= future_ms
    counts = [F.count_if(late).alias("late"), F.count_if(ahead).alias("future"), F.count_if(~late & ~ahead).alias("kept")]
    seen = None if rows.isStreaming else Observation(name)
    return rows.observe(seen if seen is not None else name, *counts).where(~late & ~ahead), seen


def compact_raw(events: DataFrame, session_events: DataFrame, frozen_ms: int | Column) -> tuple[DataFrame, DataFrame]:
    """Raw rows that stay after the freeze; a session with a row past the line stays whole."""
    alive = session_events.where(F.col("ts_ms") >= frozen_ms).select("source", "session_hash").distinct()
    return events.where(F.col("ts_ms") >= frozen_ms), session_events.join(alive, ["source", "session_hash"], "left_semi")


def rename_host(raw: DataFrame, old: str, new: str) -> DataFrame:
    return raw.withColumn("hostname", F.when(F.col("hostname") == old, new).otherwise(F.col("hostname")))


def rekey_host(derived: DataFrame, old: str, new: str, new_revision: int) -> DataFrame:
    """Derived rows of the old name under the new one, to be sent again; rows that the new name had are gone."""
    moved = F.col("hostname") == old
    return derived.where(F.col("hostname") != new).withColumns({"revision": F.when(moved, F.lit(new_revision)).otherwise(F.col("revision")).cast("long"), "synced_revision": F.when(moved, 0).otherwise(F.col("synced_revision")).cast("long"), "hostname": F.when(moved, new).otherwise(F.col("hostname"))})


def claim_unnamed(raw: DataFrame, host: str) -> DataFrame:
    """Rows without a host go to ``host``, if no other host has rows."""
    others = raw.where(~F.col("hostname").isin("", host)).limit(1).agg((F.count("*") > 0).alias("__others"))
    return raw.crossJoin(F.broadcast(others)).withColumn("hostname", F.when((F.col("hostname") == "") & ~F.col("__others"), host).otherwise(F.col("hostname"))).drop("__others")


# -- snapshots -----------------------------------------------------------------------------------


def upsert_latest(old: DataFrame, new: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """One row per key, the one with the highest sequence number."""
    all_ = old.unionByName(new)
    rest = [c for c in all_.columns if c != key]
    return all_.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, *[f"r.{c}" for c in rest])


def in_range(rows: DataFrame, a: Column | int, b: Column | int, source: str | None = None, at: str = "ts_ms") -> DataFrame:
    """Both ends belong to the range; ends in the wrong order are swapped. Ordered by time, then id."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (a, b))
    out = rows.where(F.col(at).between(F.least(a, b), F.greatest(a, b)))
    return (out if source is None else out.where(F.col("source") == source)).orderBy(at, "id")


def keep_newest(rows: DataFrame, most: int, at: str = "ts_ms") -> DataFrame:
    """The newest ``most`` rows by (time, id); 0 keeps none."""
    if most < 0:
        raise ValueError("a negative number of rows cannot be kept")
    return rows.orderBy(F.desc(at), F.desc("id")).limit(most)


def history_slice(rows: DataFrame, now_us: int | Column, points: int, at: str = "at_us") -> DataFrame:
    """The last ``points`` samples of the last ``points`` seconds, oldest first."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    return rows.where(F.col(at).between(now - (points - 1) * 1_000_000, now)).orderBy(F.desc(at)).limit(points).orderBy(at)


# -- state of a host -----------------------------------------------------------------------------


def hostname_state(hostname: Column | str, current: str) -> Column:
    """Whether rows belong to this host: unnamed, current or foreign. Only current ones may be reported."""
    h = F.trim(F.coalesce(F.col(hostname) if isinstance(hostname, str) else hostname, F.lit("")))
    return F.when(h == "", "unnamed").when(h == current, "current").otherwise("foreign")


def adopt_hostname(state: DataFrame, hostname: str) -> DataFrame:
    """``state`` has a row per host: hostname, revision, rebuild_target, parser_version, adopted. History stays as it is."""
    return state.withColumn("adopted", F.col("hostname") == hostname)


def begin_rebuild(state: DataFrame, parser_version: int) -> DataFrame:
    """A rebuild for this parser is pending from here on; revisions never fall back."""
    return state.withColumn("rebuild_target", F.lit(parser_version).cast("long"))


def rebuild_pending(state: DataFrame) -> DataFrame:
    return state.where(F.col("rebuild_target").isNotNull())


def complete_rebuild(state: DataFrame) -> DataFrame:
    """The pending parser version becomes the version; hosts without a pending rebuild stay."""
    return state.withColumns({"parser_version": F.coalesce("rebuild_target", "parser_version"), "rebuild_target": F.lit(None).cast("long")})

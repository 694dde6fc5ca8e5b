"""Mixing sources to target weights by Pfair scheduling.

Every source's rows are put in a reproducible random order and cut into blocks. A source with integer share a out of a period of Q slots
has block k of the period released at floor(k Q / a) and due at ceil((k + 1) Q / a); among released blocks the
earliest deadline goes first. With all shares summing to Q, every block meets its window, so after any number t of
slots a source stands less than one block from a t / Q. The schedule repeats after Q slots, so only one period is worked out
and rows find their slot by joins. When a source is used up, the others go on with the same shares of a
smaller period: a new phase. Every row is placed exactly once.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BUCKET_ROWS = 1024
STRETCH = 4096  # buckets whose sizes one task sums up


def period_schedule(shares: dict[str, int]) -> list[str]:
    """Source of each slot of one period, by earliest deadline among released blocks; ties go to the larger share, then the name."""
    q = sum(shares.values())
    later = [(0, s, 0) for s in sorted(shares)]  # release, source, block
    heapq.heapify(later)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for slot in range(q):
        while later and later[0][0] <= slot:
            _, s, k = heapq.heappop(later)
            heapq.heappush(ready, (-(-(k + 1) * q // shares[s]), -shares[s], s, k))
        due, _, s, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        out.append(s)
        if k + 1 < shares[s]:
            heapq.heappush(later, ((k + 1) * q // shares[s], s, k + 1))
    return out


def temperature_shares(counts: dict[str, int], alpha: float = 0.7, period: int = 1024) -> dict[str, int]:
    """Integer shares of about ``period`` slots in proportion to count ** alpha, one at least."""
    total = sum(n**alpha for n in counts.values())
    return {s: max(1, round(period * n**alpha / total)) for s, n in counts.items()}


def phases(blocks: dict[str, int], shares: dict[str, int]) -> tuple[list[dict], list[dict]]:
    """Phase rows (one per phase and source in it) and pattern rows (one per phase and slot of its period)."""
    left = {s: n for s, n in blocks.items() if n > 0}
    used, slot, spans, patterns, phase = dict.fromkeys(left, 0), 0, [], [], 0
    while left:
        common = reduce(math.gcd, (shares[s] for s in left))
        share = {s: shares[s] // common for s in left}
        q, order = sum(share.values()), period_schedule(share)
        whole = min(n // share[s] for s, n in left.items())
        taken = {s: whole * share[s] for s in left}
        length, count = whole * q, dict.fromkeys(left, 0)
        if all(left[s] > taken[s] for s in left):  # none is used up by whole periods: go on until one is asked for in vain
            for s in order:
                if taken[s] + count[s] == left[s]:
                    break
                count[s] += 1
                length += 1
        k = dict.fromkeys(left, 0)
        for at, s in enumerate(order):
            patterns.append({"phase": phase, "source_key": s, "k": k[s], "offset": at})
            k[s] += 1
        for s in left:
            n = taken[s] + count[s]
            spans.append({"source_key": s, "phase": phase, "first": used[s], "end": used[s] + n, "slot0": slot, "share": share[s], "period": q})
            used[s] += n
        left = {s: n - taken[s] - count[s] for s, n in left.items() if n > taken[s] + count[s]}
        slot, phase = slot + length, phase + 1
    return spans, patterns


def mix_sources(
    docs: DataFrame,
    shares: dict[str, int] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = 16,
    alpha: float = 0.7,
    period: int = 1024,
    bucket_rows: int = BUCKET_ROWS,
    stretch: int = STRETCH,
) -> DataFrame:
    """``docs`` with block, phase, release, deadline, slot and position appended; sort by position to read the mix.

    ``shares`` maps source names to integer target weights; without it they are count ** alpha, scaled to ``period``. Sources that
    ``shares`` doesn't name get the share one. A null source is a source of its own. Each row appears exactly once;
    the last block of a source may be short. Rows with null ids are ordered by their other columns; repeated rows stay, next to each other. An
    empty table gives no rows. Columns of the appended names are replaced. Sources are assumed to be few enough
    that one row per source fits the driver (their counts are collected); no rows are.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    fields = [c for c in docs.columns if c not in ("block", "phase", "release", "deadline", "slot", "position")]
    order = F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(*[F.col(f"`{c}`") for c in fields])))  # the same in every evaluation
    base = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(fields)], key.alias("source_key"), order.alias("h"))
    sizes = {r["source_key"]: r["n"] for r in base.groupBy("source_key").agg(F.count("*").alias("n")).collect()}
    if shares is None:
        share = temperature_shares(sizes, alpha, period)
    else:
        share = {s: shares.get(s[1:] if s[0] == "=" else None, 1) for s in sizes}
    spans, patterns = phases({s: -(-n // block_rows) for s, n in sizes.items()}, share)
    spark = docs.sparkSession
    span = spark.createDataFrame(pd.DataFrame(spans, columns=["source_key", "phase", "first", "end", "slot0", "share", "period"]),
                                 "source_key string, phase int, first long, end long, slot0 long, share long, period long")
    pattern = spark.createDataFrame(pd.DataFrame(patterns, columns=["phase", "source_key", "k", "offset"]), "phase int, source_key string, k long, offset long")
    small = lambda df, rows: F.broadcast(df) if len(rows) <= 200_000 else df  # noqa: E731  beyond that, an ordinary join

    # ranks within a source, without one task per source: rows are dealt into hash ranges of about bucket_rows, whose sizes are summed up stretch by stretch
    n_buckets = spark.createDataFrame([(s, -(-n // bucket_rows)) for s, n in sizes.items()], "source_key string, n_buckets long")
    unit = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
    dealt = base.join(small(n_buckets, sizes), "source_key").withColumn("bucket", F.floor(unit * F.col("n_buckets")))
    sums = stored(dealt.groupBy("source_key", "bucket").agg(F.count("*").alias("n")).withColumn("stretch", F.floor(F.col("bucket") / stretch)), "bucket_sizes")
    earlier = lambda keys, at: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.groupBy("source_key", "stretch").agg(F.sum("n").alias("n")).select("source_key", "stretch", earlier(["source_key"], "stretch").alias("base"))
    starts = sums.withColumn("start", earlier(["source_key", "stretch"], "bucket")).join(bases, ["source_key", "stretch"])
    starts = starts.select("source_key", "bucket", (F.col("start") + F.col("base")).alias("start"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("h")
    ranked = dealt.withColumn("in_bucket", F.row_number().over(inside) - 1).join(starts, ["source_key", "bucket"])
    ranked = ranked.withColumn("rank", F.col("start") + F.col("in_bucket")).withColumn("block", F.floor(F.col("rank") / block_rows))
    placed = ranked.join(small(span, spans), "source_key").where("block >= first and block < end").withColumn("j", F.col("block") - F.col("first"))
    placed = placed.withColumn("turn", F.floor(F.col("j") / F.col("share"))).withColumn("k", F.col("j") % F.col("share"))
    placed = placed.join(small(pattern, patterns), ["phase", "source_key", "k"])
    slot = F.col("slot0") + F.col("turn") * F.col("period") + F.col("offset")
    return placed.select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(fields)],
        F.col("block").cast("long").alias("block"),
        "phase",
        (F.col("slot0") + F.floor(F.col("j") * F.col("period") / F.col("share"))).cast("long").alias("release"),
        (F.col("slot0") + F.ceil((F.col("j") + 1) * F.col("period") / F.col("share"))).cast("long").alias("deadline"),
        slot.cast("long").alias("slot"),
        (slot * block_rows + F.col("rank") % block_rows).cast("long").alias("position"),
    )

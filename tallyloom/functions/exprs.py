"""Column builders: token arithmetic, times, maps, names and formats. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.schemas import BUCKET_MS, COUNTS, EDIT_LINE_CAP, MAX_LONG, NAME_CAP, UNKNOWN


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are worked out once a row, however often later steps name them.

    The optimiser copies expressions through projections and into filters, so that one field of a line would be parsed again for each use; it doesn't copy them through a generator.
    """
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


# -- numbers -------------------------------------------------------------------------------------


def clamp_long(c: Column) -> Column:
    """A decimal as a long that stops at the largest long and never goes below zero."""
    return F.least(F.greatest(c, F.lit(0)), F.lit(MAX_LONG).cast("decimal(38,0)")).cast("long")


def saturating_sum(c: Column | str) -> Column:
    """Sum of longs that stops at the largest long where an ANSI sum would raise."""
    return clamp_long(F.sum(col(c).cast("decimal(38,0)")))


def saturating_add(*cs: Column | str) -> Column:
    return clamp_long(reduce(lambda a, b: a + b, (F.coalesce(col(c), F.lit(0)).cast("decimal(30,0)") for c in cs)))


def positive_difference(a: Column | str, b: Column | str) -> Column:
    return clamp_long(col(a).cast("decimal(30,0)") - col(b).cast("decimal(30,0)"))


def component_sum(prefix: str = "") -> Column:
    return saturating_add(*[f"{prefix}{c}" for c in COUNTS])


def total_of(reported: Column | str, prefix: str = "") -> Column:
    """The reported total, but never less than its parts."""
    return F.greatest(F.coalesce(col(reported), F.lit(0)), component_sum(prefix))


def rollout_counts(inp, cached, cache_read, creation, out, reasoning, reported) -> Column:
    """Disjoint parts of a rollout's usage, whose input and output include their parts."""
    n = lambda c: F.greatest(F.coalesce(col(c), F.lit(0)), F.lit(0)).cast("long")
    hit = F.least(n(inp), saturating_add(n(cached), n(cache_read)))
    made = F.least(F.greatest(n(inp) - hit, F.lit(0)), n(creation))
    think = F.least(n(out), n(reasoning))
    parts = [(n(inp) - hit - made).alias("input"), (n(out) - think).alias("output"), hit.alias("cached_input"), made.alias("cache_creation"), think.alias("reasoning")]
    return F.struct(*parts, F.greatest(n(reported), n(inp) + n(out)).alias("total"))


def coerce_long(v: Column, path: str) -> Column:
    """A number, numeric text or boolean in a VARIANT as a long, else zero."""
    return F.coalesce(F.try_variant_get(v, path, "bigint"), F.expr("0L"))


def reasoning_split(thinking: Column | str, other: Column | str, output: Column | str) -> Column:
    """Share of the output tokens that fell to thinking, by size, rounded half up in 128-bit arithmetic."""
    think, rest, out = (F.greatest(F.coalesce(col(c), F.lit(0)), F.lit(0)).cast("decimal(19,0)") for c in (thinking, other, output))
    whole = think + rest
    share = F.floor((out * think * 2 + whole) / (whole * 2)).cast("decimal(38,0)")
    return F.when(whole > 0, F.least(out.cast("decimal(38,0)"), share)).otherwise(F.lit(0)).cast("long")


def cap_lines(added: Column | str, deleted: Column | str) -> Column:
    """Edits of more than the cap count as none."""
    over = col(added) + col(deleted) > EDIT_LINE_CAP
    return F.struct(F.when(over, 0).otherwise(col(added)).cast("long").alias("added"), F.when(over, 0).otherwise(col(deleted)).cast("long").alias("deleted"))


def cost(inp, out, cached, reasoning, price: Column) -> Column:
    """US dollars; price: struct of USD per million. Creating a cache is not billed."""
    d = lambda c: col(c).cast("double")
    return (d(inp) * price["input_price"] + d(out) * price["output_price"] + d(cached) * price["cache_price"] + d(reasoning) * price["reasoning_price"]) / 1_000_000


def share_or_null(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def upstream_basis(total: Column | str, creation: Column | str) -> Column:
    return F.greatest(col(total) - col(creation), F.lit(0))


# -- times ---------------------------------------------------------------------------------------


def millis(ts: Column | str) -> Column:
    """Milliseconds since the epoch, rounded (the built-in truncates and takes no TIMESTAMP_NTZ)."""
    return F.round(F.unix_micros(col(ts).cast("timestamp")) / 1000).cast("long")


def micros(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def bucket_start(ms: Column | str, width: int = BUCKET_MS) -> Column:
    return F.floor(col(ms) / width).cast("long") * width


def parse_time(text: Column | str) -> Column:
    """RFC 3339 with a zone, or seconds or milliseconds since the epoch (over 1e12); anything else is null."""
    t = F.trim(col(text))
    zoned = t.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})$")
    number = F.try_to_number(F.when(t.rlike(r"^\d{1,15}$"), t), F.lit("999999999999999")).cast("decimal(20,6)")
    decimal = F.when(t.rlike(r"^\d{1,15}(\.\d{1,6})?$"), t).cast("decimal(24,6)")
    seconds = F.when(F.coalesce(decimal, number) > 1_000_000_000_000, F.coalesce(decimal, number) / 1000).otherwise(F.coalesce(decimal, number))
    return F.when(zoned, F.try_to_timestamp(F.upper(t))).otherwise(F.timestamp_micros((seconds * 1_000_000).cast("long")))


def day_bounds(ref: Column, zone: str) -> tuple[Column, Column]:
    """Start and end of the calendar day around an instant; both come from local midnights, so a day may have 23 or 25 hours."""
    local = F.date_trunc("day", F.from_utc_timestamp(ref, zone))
    return F.to_utc_timestamp(local, zone), F.to_utc_timestamp(F.date_trunc("day", local + F.expr("INTERVAL 36 HOURS")), zone)


def window_bounds(window: str, ref: Column, zone: str = "UTC") -> tuple[Column, Column] | None:
    """[start, end) of day (calendar), week or month (rolling 7 and 30 days); None for all."""
    if window == "day":
        return day_bounds(ref, zone)
    if window in ("week", "month"):
        return ref - F.expr(f"INTERVAL {168 if window == 'week' else 720} HOURS"), ref
    if window == "all":
        return None
    raise ValueError(f"unknown window {window!r}")


def stable_uuid(seconds: Column | str) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.lower(F.hex(col(seconds).cast("long"))), 12, "0"))


# -- maps and lists ------------------------------------------------------------------------------


def merge_sum(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: saturating_add(x, y))


def merge_max(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, y), F.coalesce(y, x)))


def normalise_counts(m: Column | str) -> Column:
    """Keys trimmed and cut to the cap, counts of keys that then agree added, empty keys and counts below one dropped."""
    entries = F.transform(F.map_entries(col(m)), lambda e: F.struct(F.substring(F.trim(e["key"]), 1, NAME_CAP).alias("k"), e["value"].alias("v")))
    good = F.filter(entries, lambda e: (e["k"] != "") & (e["v"] > 0))
    keys = F.array_sort(F.array_distinct(F.transform(good, lambda e: e["k"])))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.aggregate(F.filter(good, lambda e: e["k"] == k), F.lit(0).cast("long"), lambda a, e: a + e["v"])))


def counts_text(m: Column | str) -> Column:
    """``k=v,`` pairs in key order: a fingerprint that equal maps share."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(col(m))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def normalise_names(a: Column | str) -> Column:
    """Trimmed, non-empty, each once, in first order."""
    return F.array_distinct(F.filter(F.transform(col(a), lambda x: F.substring(F.trim(x), 1, NAME_CAP)), lambda x: x != ""))


def names_with_keys(a: Column, m: Column) -> Column:
    return F.array_sort(F.array_union(normalise_names(a), F.map_keys(m)))


# -- names, paths and text -----------------------------------------------------------------------


def known(c: Column | str, default: str = UNKNOWN) -> Column:
    """The trimmed text, or the default where there is none."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(t == "", default).otherwise(t)


def is_unknown(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(col(c), F.lit("")))).isin("", UNKNOWN)


def display_model(c: Column | str, placeholder: str = "(none)") -> Column:
    return F.when(F.trim(F.coalesce(col(c), F.lit(""))).isin("", "<synthetic>"), placeholder).otherwise(col(c))


def last_component(path: Column | str) -> Column:
    return F.element_at(F.split(F.regexp_replace(col(path), "/+$", ""), "/"), -1)


def hash_id(*parts: Column | str, length: int = 64) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *[col(p) for p in parts]), 256), F.lit(length))


def mcp_server(name: Column | str) -> Column:
    """Server of ``mcp__server__tool``; null if the name is none or the tool is blank."""
    got = F.regexp_extract(col(name), r"(?s)^mcp__(.*?)__(.*\S.*)$", 1)
    return F.nullif(F.trim(got), F.lit(""))


def skill_markers(text: Column | str) -> Column:
    """Skills that ``[$name](.../SKILL.md)`` names, each once."""
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(r"\[\$([A-Za-z0-9_.:+-]+)\]\([^)]*?/SKILL\.md\)"), 1))


def under_automation(path: Column | str, roots: tuple[str, ...] = ()) -> Column:
    """A component is ``automations``, or the path lies in one of the roots."""
    p = F.regexp_replace(F.lower(F.trim(col(path))), "/+$", "")
    inside = F.array_contains(F.split(p, "/"), "automations")
    for r in roots:
        r = r.strip().lower().rstrip("/")
        inside = inside | (p == r) | p.startswith(r + "/")
    return inside


# Files that tools write, which count as no one's edit.
GENERATED_NAMES = ["bun.lockb", "cargo.lock", "composer.lock", "flake.lock", "gemfile.lock", "go.sum", "package-lock.json", "pnpm-lock.yaml", "podfile.lock", "poetry.lock", "yarn.lock"]
GENERATED_SUFFIXES = [".freezed.dart", ".g.dart", ".generated.go", ".lock", ".min.css", ".min.js", ".pb.go", "_gen.go", "_pb2.py"]
GENERATED_FOLDERS = [".git", ".next", ".venv", "build", "dist", "node_modules", "site-packages", "target", "third_party", "vendor"]


def generated_path(path: Column | str) -> Column:
    """Lock files, generated suffixes, or a component that holds generated or foreign code. Empty paths are not."""
    p = F.lower(F.coalesce(F.replace(col(path), F.lit("\\"), F.lit("/")), F.lit("")))
    suffix = reduce(lambda a, b: a | b, (p.endswith(x) for x in GENERATED_SUFFIXES))
    return F.element_at(F.split(p, "/"), -1).isin(*GENERATED_NAMES) | suffix | F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(x) for x in GENERATED_FOLDERS]))


def process_kind(path: Column | str) -> Column:
    """What a program's path says it is. Helpers inside an application bundle are no command-line tools."""
    p = col(path)
    name, bundled = F.element_at(F.split(p, "/"), -1), F.lower(p).contains(".app/contents/")
    return (
        F.when(p.contains("/ChatGPT.app/"), "codex_desktop")
        .when((name == "Claude") & p.contains("/Claude.app/Contents/MacOS/"), "claude_desktop")
        .when((name == "codex") & ~bundled, "codex_cli")
        .when((name == "claude") & ~bundled, "claude_cli")
        .otherwise("other")
    )


def source_of_originator(originator: Column | str) -> Column:
    return F.when(col(originator) == "codex_exec", "cli").when(col(originator) == "Codex Desktop", "desktop")


def truncate_utf8(text: Column | str, most: int) -> Column:
    """At most ``most`` bytes, cut between characters."""
    b = F.encode(col(text), "UTF-8")
    # a byte 10xxxxxx after the cut means that it falls into a character: step back to that character's first byte
    inside = lambda at: (F.conv(F.hex(F.substring(b, at, 1)), 16, 10).cast("int").bitwiseAND(0xC0)) == 0x80
    cut = most
    end = F.when(~inside(cut + 1), cut).when(~inside(cut), cut - 1).when(~inside(cut - 1), cut - 2).otherwise(cut - 3)
    return F.when(F.octet_length(col(text)) <= most, col(text)).otherwise(F.decode(F.substring(b, F.lit(1), end), "UTF-8"))


def mask_secret(text: Column | str) -> Column:
    t = col(text)
    return F.when(F.length(t) <= 8, F.repeat(F.lit("*"), F.length(t).cast("int"))).otherwise(F.concat(F.left(t, F.lit(4)), F.lit("****"), F.right(t, F.lit(4))))


DASH = "\u2014"


def tokens_text(n: Column | str) -> Column:
    """1234 -> 1.23K; K, M and B with two decimals; null -> a dash."""
    v = col(n)
    unit = lambda by, u: F.format_string(f"%.2f{u}", v.cast("double") / by)
    return F.when(v.isNull(), DASH).when(F.abs(v) >= 1_000_000_000, unit(1e9, "B")).when(F.abs(v) >= 1_000_000, unit(1e6, "M")).when(F.abs(v) >= 1000, unit(1e3, "K")).otherwise(v.cast("string"))


def compact_tokens_text(n: Column | str) -> Column:
    """Two digits at most: the largest unit that leaves 0.1 to 100; whole numbers from 10 on; K for what is smaller."""
    v = col(n).cast("double")
    out = F.when(v.isNull(), DASH)
    for by, u in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        x = v / by
        fits = (F.abs(x) >= 0.1) & (F.abs(x) < 100)
        out = out.when(fits & (F.abs(x) >= 10), F.format_string(f"%.0f{u}", x)).when(fits, F.format_string(f"%.1f{u}", x))
    return out.when(F.abs(v) >= 1e9, F.format_string("%.0fB", v / 1e9)).otherwise(F.format_string("%.1fK", v / 1e3))


def percent_text(x: Column | str) -> Column:
    return F.when(col(x).isNull(), DASH).otherwise(F.format_string("%.1f%%", col(x) * 100))


def money_text(x: Column | str) -> Column:
    return F.when(col(x).isNull(), DASH).when(col(x) >= 100, F.format_string("$%.0f", col(x))).otherwise(F.format_string("$%.2f", col(x)))


def age_text(then: Column | str, now: Column | str) -> Column:
    """just now, 5m ago, 3h ago, 2d ago, and the date after a week; null -> a dash."""
    s = (F.unix_micros(col(now)) - F.unix_micros(col(then))) / 1_000_000
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(f"{u} ago"))
    return (
        F.when(col(then).isNull(), DASH).when(s < 60, "just now").when(s < 3600, unit(60, "m")).when(s < 86_400, unit(3600, "h")).when(s < 7 * 86_400, unit(86_400, "d"))
        .otherwise(F.date_format(col(then), "MM-dd HH:mm"))
    )


def zone_offset(at: Column | str, zone: str) -> Column:
    """A zone's distance from UTC at an instant, as +hh:mm."""
    t = col(at)
    minutes = F.floor((F.unix_micros(F.from_utc_timestamp(t, zone)) - F.unix_micros(F.from_utc_timestamp(t, "UTC"))) / 60_000_000)
    return F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60)

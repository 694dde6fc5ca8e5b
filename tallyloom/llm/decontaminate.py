"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders, the rest is lower-cased words. Windows of template words are hashed and
joined with the windows of the benchmark. Matches on one diagonal (document place minus item place) are checked for slot consistency: each of an item's slot
values is mapped to the document value that stands for it most often, and a window counts if at least half of its slots agree with that: two slots of an item may have equal values by chance. Currency
signs stand behind their number, as units do. Words of mixed or upper case are names (the latter not where over half of a text's words are). A capitalised word that opens a sentence may be a name or not, so windows that hold one are
read both ways. Plain lower-case windows are joined too, so a verbatim passage in other letter case is found. Items whose windows have too few
literal words are looked for as one whole template. What share of an item's windows is matched decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that name a unit when they follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms t ton tons tonne tonnes oz ounce ounces lb lbs pound pounds "
    "ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hrs hour hours day days week weeks month months year years "
    "ms kmh kph mph degree degrees c f k percent usd eur gbp dollar dollars euro euros cent cents hz khz mhz ghz w kw kwh v volt volts watt watts j joule joules n newton newtons pa kpa b kb mb gb tb byte bytes bit bits $ € £ ¥".split()
)
MONEY = re.compile(r"([$€£¥]|\b(?:USD|EUR|GBP))\s?(\d+(?:[.,]\d+)*)")
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?:\n]")
SIGNED = re.compile(TOKEN.pattern + r"|(?<=\d )[$€£¥]|(?<=\d)[$€£¥]")
MARKS = "$", "€", "£", "¥", "USD", "EUR", "GBP"
ENDS = frozenset(".!?:\n")
PLACEHOLDERS = "<number>", "<name>", "<unit>"
NUMBER, NAME, UNIT = 1, 2, 3  # kinds; 0: literal
LEAST_LITERAL = 4  # words other than placeholders that a window must have
WHOLE_LITERAL, WHOLE_WORDS = 3, (5, 64)  # literal words and length of an item that is looked for as one template
FEW_TYPED = 0.25  # an item with fewer template windows than this share is looked for as one template
TYPED = ("template", "open", "whole")
BASE = 0x9E3779B97F4A7C15
IS_END, IS_NUMBER, IS_UNIT, IS_CAPITAL, IS_UPPER = 1, 2, 4, 8, 16
FLAG_BITS = 5


def code(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode()) or 1


class Words(dict):
    """Token -> its number in the vocabulary (0: none) and flags, in one integer; filled as tokens are met."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        low = token.lower()
        flags = IS_END if token in ENDS else IS_NUMBER if token[0].isdigit() else IS_UNIT * (low in UNITS) | (len(token) > 1 and token[0].isupper()) * (IS_UPPER if token.isupper() else IS_CAPITAL)
        self[token] = known = self.vocabulary.get(low, 0) << FLAG_BITS | flags
        return known


class Reading(NamedTuple):
    """Words of a text: their tokens, numbers in the vocabulary, and kinds with names inside sentences only, and with names at their starts too."""

    tokens: list[str]
    at: np.ndarray  # places of the words among the tokens
    known: np.ndarray
    kinds: np.ndarray
    open_kinds: np.ndarray

    def word(self, k: int) -> str:
        return self.tokens[self.at[k]].lower()


def tokens_of(text: str | None) -> list[str]:
    """Words, numbers and sentence ends; currency signs and codes come behind their number."""
    if not text:
        return []
    return SIGNED.findall(MONEY.sub(r"\2 \1", text)) if any(m in text for m in MARKS) else TOKEN.findall(text)


def read(text: str | None, words: Words) -> Reading:
    tokens = tokens_of(text)
    packed = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    if len(words) > 300_000:
        words.clear()
    flags = packed & ((1 << FLAG_BITS) - 1)
    before = np.concatenate(([IS_END], flags[:-1]))[: len(flags)]
    number, unit, capital, upper = ((flags & f) > 0 for f in (IS_NUMBER, IS_UNIT, IS_CAPITAL, IS_UPPER))
    if 2 * np.count_nonzero(upper) <= np.count_nonzero(flags & (IS_END | IS_NUMBER) == 0):
        capital |= upper
    rest = np.where(unit & (before & IS_NUMBER > 0), UNIT, 0)
    rest = np.where(number, NUMBER, rest)
    open_kinds = np.where((rest == 0) & capital, NAME, rest)
    kinds = np.where((rest == 0) & capital & (before & IS_END == 0), NAME, rest)
    at = np.flatnonzero(flags & IS_END == 0)
    return Reading(tokens, at, packed[at] >> FLAG_BITS, kinds[at], open_kinds[at])


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[k] = np.concatenate(([np.uint64(1)], np.full(2 * n, base, np.uint64))).cumprod(dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def windows(codes: np.ndarray, enough: np.ndarray, width: int, least: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows without an unknown word (code 0), with ``least`` literal words (``enough``) and, if given, a word of ``within``."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, int), np.zeros(0, np.uint64)
    total = lambda x: (c := np.concatenate(([0], np.cumsum(x))))[width:] - c[:-width]
    good = (total(codes != 0) == width) & (total(enough) >= least)
    if within is not None:
        good &= total(within) > 0
    at = np.flatnonzero(good)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    up, down = powers(len(codes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up, dtype=np.uint64)))
    h = (sums[at + width] - sums[at]) * down[at]
    return at, h ^ (h >> np.uint64(29))


def forms(r: Reading, codes: np.ndarray, holders: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """The ways a text is read: name, codes, literal words, words of which a window must hold one, and kinds of the slots."""
    plain = codes[r.known]
    yield "plain", plain, np.ones(len(plain), bool), None, None
    yield "template", np.where(r.kinds == 0, plain, holders[r.kinds]), r.kinds == 0, None, r.kinds
    starts = r.kinds != r.open_kinds
    if starts.any():
        yield "open", np.where(r.open_kinds == 0, plain, holders[r.open_kinds]), r.open_kinds == 0, starts, r.open_kinds


class Index(NamedTuple):
    rows: list[tuple]  # form, hash, item_id, item_at, slots [(place in window, value)]
    sizes: list[tuple[int, int, int]]  # item_id, windows, template windows
    vocabulary: dict[str, int]  # words of the items -> their number from 1
    codes: np.ndarray  # of every word, by number
    holders: np.ndarray  # codes of the placeholders, by kind
    hashes: dict[tuple[str, int], np.ndarray]  # (form, width) -> sorted window hashes


def item_index(items: list[tuple[int, str]], width: int) -> Index:
    """Windows of the items that have at least four words; items shorter than ``width`` are one window."""
    found = {t.lower() for _, text in items for t in tokens_of(text) if t not in ENDS}
    vocabulary = {w: k for k, w in enumerate(sorted(found), 1)}
    codes, holders = (np.array([0, *map(code, x)], np.uint64) for x in (vocabulary, PLACEHOLDERS))
    words, rows, sizes, hashes = Words(vocabulary), [], [], {}

    def add(form: str, item_id: int, r: Reading, at: np.ndarray, h: np.ndarray, own: int, kinds: np.ndarray | None) -> None:
        hashes.setdefault((form, own), []).append(h)
        for i, x in zip(at.tolist(), h.view(np.int64).tolist()):
            rows.append((form, x, item_id, i, [(j, r.word(i + j)) for j in range(own) if kinds is not None and kinds[i + j]]))

    for item_id, text in items:
        r = read(text, words)
        n = len(r.at)
        own = min(width, n)
        if own < LEAST_LITERAL:
            continue
        typed: set[int] = set()
        for form, names, literal, within, kinds in forms(r, codes, holders):
            at, h = windows(names, literal, own, LEAST_LITERAL, within)
            add(form, item_id, r, at, h, own, kinds)
            typed |= set() if kinds is None else set(at.tolist())
        if len(typed) < FEW_TYPED * (n - own + 1) and WHOLE_WORDS[0] <= n <= WHOLE_WORDS[1]:
            names = np.where(r.open_kinds == 0, codes[r.known], holders[r.open_kinds])
            at, h = windows(names, r.open_kinds == 0, n, WHOLE_LITERAL)
            add("whole", item_id, r, at, h, n, r.open_kinds)
        sizes.append((item_id, n - own + 1, len(typed)))
    return Index(rows, sizes, vocabulary, codes, holders, {k: np.unique(np.concatenate(h)) for k, h in hashes.items()})


def matches(text: str | None, index: Index, words: Words) -> list[tuple[str, int, int, list[tuple[int, str]]]]:
    """The windows of one text that the index has: form, hash, place, slots."""
    r, out = read(text, words), []
    read_as = {f[0]: f[1:] for f in forms(r, index.codes, index.holders)}
    last = read_as.get("open") or read_as["template"]
    read_as["whole"] = (*last[:2], None, last[3])
    for (form, width), wanted in index.hashes.items():
        if form not in read_as or not len(wanted):
            continue
        names, literal, within, kinds = read_as[form]
        at, h = windows(names, literal, width, WHOLE_LITERAL if form == "whole" else LEAST_LITERAL, within)
        if not len(h):
            continue
        hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
        for i, x in zip(at[hit].tolist(), h[hit].view(np.int64).tolist()):
            out.append((form, x, i, [(j, r.word(i + j)) for j in range(width) if kinds is not None and kinds[i + j]]))
    return out


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 8,
    least: float = 0.4,
    block_chars: int = 8_000_000,
) -> DataFrame:
    """One row per document and benchmark item found in it.

    Columns: id, row_key (xxhash64 of the text, which tells rows with null or repeated ids apart), item_id, n_windows
    (distinct windows of the item found with agreeing slots), coverage (their share of the item's, or the share of its template windows if these
    are at least a quarter of all, or 1 for an item found as one whole template), n_slots, n_changed (slots
    with another value), reparameterised (some slot has another value).

    Null and empty texts hold nothing; items with a null id or under four words are not looked for. Repeated rows give one
    row. The benchmark is looked for in blocks of about ``block_chars`` characters of items, which bounds what is broadcast; one
    block is the usual case; the documents are read once for each block, so the benchmark side is meant to be of some hundred MB at most.
    An empty table on either side gives no rows.
    """
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull())
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).distinct()
    blocks = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars) or 1
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = []
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        found.append(_found(texts, item_index([(r["item_id"], r["text"]) for r in part.collect()], width), least))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out.withColumnRenamed("id", id_col)


def _found(texts: DataFrame, index: Index, least: float) -> DataFrame:
    spark, slots = texts.sparkSession, "array<struct<j:int,value:string>>"
    known = F.broadcast(spark.createDataFrame(index.rows, f"form string, hash long, item_id long, item_at int, item_slots {slots}"))
    sizes = F.broadcast(spark.createDataFrame(index.sizes, "item_id long, item_windows int, item_typed int"))
    light = index._replace(rows=[], sizes=[])
    kind = pa.list_(pa.struct([("j", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(light.vocabulary)
        for batch in batches:
            rows = [(n, *m) for n, t in enumerate(batch.column(2).to_pylist()) for m in matches(t, light, words)]
            who = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(who),
                    batch.column(1).take(who),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int32()),
                    pa.array([[{"j": j, "value": v} for j, v in r[4]] for r in rows], kind),
                ],
                ["id", "row_key", "form", "hash", "at", "slots"],
            )

    hits = texts.select("id", F.xxhash64("text").alias("row_key"), "text").mapInArrow(
        run, f"id long, row_key long, form string, hash long, at int, slots {slots}"
    )
    pair = lambda a, b: F.struct((F.col("item_at") + a["j"]).alias("place"), a["value"].alias("item"), b["value"].alias("doc"))
    lined = hits.join(known, ["form", "hash"]).withColumn("pairs", F.zip_with("item_slots", "slots", pair))
    by_diagonal = lined.groupBy("id", "row_key", "item_id", "form", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.collect_set(F.struct("item_at", "pairs")).alias("windows"))
    slots_of = lambda w: F.array_distinct(F.flatten(F.transform(w, lambda x: x["pairs"])))
    by_diagonal = by_diagonal.withColumn("slots", slots_of(F.col("windows")))
    values = F.array_distinct(F.transform("slots", lambda s: F.struct(s["item"], s["doc"])))
    by_diagonal = by_diagonal.withColumn("values", values)
    often = lambda v: -F.size(F.filter("slots", lambda s: (s["item"] == v["item"]) & (s["doc"] == v["doc"])))
    clash = F.size("values") > F.size(F.array_distinct(F.transform("values", lambda v: v["item"])))
    by_diagonal = by_diagonal.withColumn("ranked", F.when(clash, F.array_sort(F.transform("values", lambda v: F.struct(v["item"].alias("item"), often(v).alias("n"), v["doc"].alias("doc"))))))
    first = F.filter("ranked", lambda v, i: (i == 0) | (v["item"] != F.get("ranked", i - 1)["item"]))  # an item value's most frequent document value; of equals the smaller
    by_diagonal = by_diagonal.withColumn("mapped", first)
    agrees = lambda p: F.exists("mapped", lambda m: (m["item"] == p["item"]) & (m["doc"] == p["doc"]))
    agreeing = F.filter("windows", lambda w: 2 * F.size(F.filter(w["pairs"], agrees)) >= F.size(w["pairs"]))
    good = by_diagonal.withColumn("windows", F.when(F.col("ranked").isNull(), F.col("windows")).otherwise(agreeing)).where(F.size("windows") > 0)
    good = good.withColumns({"places": F.transform("windows", lambda w: w["item_at"]), "slots": slots_of(F.col("windows"))})
    good = good.withColumn("changed", F.size(F.filter("slots", lambda s: s["item"] != s["doc"])))
    typed = F.when(F.col("form").isin(*TYPED), F.col("places"))
    per_item = good.groupBy("id", "row_key", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("n_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_set(typed)))).alias("n_typed"),
        F.max((F.col("form") == "whole").cast("int")).alias("whole"),
        F.max(F.size("slots")).cast("int").alias("n_slots"),
        F.min(F.struct(-F.size("places"), "changed")).getField("changed").alias("n_changed"),
    )
    of_typed = F.when(F.col("item_typed") >= FEW_TYPED * F.col("item_windows"), F.col("n_typed") / F.greatest("item_typed", F.lit(1)))
    share = F.when(F.col("whole") == 1, 1.0).otherwise(F.greatest(F.col("n_windows") / F.col("item_windows"), F.coalesce(of_typed, F.lit(0.0))))
    return (
        per_item.join(sizes, "item_id")
        .where(share >= least)
        .select("id", "row_key", "item_id", "n_windows", share.alias("coverage"), "n_slots", "n_changed", (F.col("n_changed") > 0).alias("reparameterised"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all others stay as they are."""
    hits = contaminated(docs, benchmark, id_col, text_col, **how).select(F.col(id_col).alias("__id"), F.col("row_key").alias("__key")).distinct()
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__key"))
    return docs.join(hits, same, "left_anti")

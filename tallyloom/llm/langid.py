"""Language identification by compression.

A bounded sample of labelled rows gives one zstandard raw-content dictionary per language. A text, reduced to lower-case
letters and single spaces, is compressed block by block with every dictionary; the language with the smallest sum
of sizes wins. A text is rejected when the second smallest is hardly larger: how much is hardly is learned from other labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_LETTERS = regex.compile(r"\P{L}+")
UNDETERMINED = "und"


def letters(text: str | None) -> bytes:
    """Lower-case letters in runs joined by one space; empty if there is no letter."""
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode() if text else b""


def learn_dictionaries(
    labelled: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    key_col: str = "doc_id",
    rows_per_language: int = 500,
    row_chars: tuple[int, int] = (100, 4000),
    dictionary_bytes: int = 1 << 17,
) -> dict[str, bytes]:
    """Language -> raw dictionary content, from at most about ``rows_per_language`` rows of each language.

    Rows are drawn by the hash of key and text, so null and repeated keys are drawn like others and rows that repeat both count once; rows of ``row_chars`` characters come first; a language with too few of these also gives shorter
    texts and the first ``row_chars[1]`` characters of longer ones, so every language with a labelled letter is learned. What reaches the driver is
    bounded by languages x rows x characters (twice the expected number of rows is a hard limit). Rows with null language or text are not used.
    """
    inside = F.length(text_col).between(*row_chars)
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.col(lang_col).alias("lang"), inside.alias("inside"), F.substring(text_col, 1, row_chars[1]).alias("text"), F.xxhash64(key_col, text_col).alias("h"))
    counts = {(r["lang"], r["inside"]): r["n"] for r in usable.groupBy("lang", "inside").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}
    wanted = {}
    for (lang, within), n in counts.items():
        room = rows_per_language if within else rows_per_language - min(rows_per_language, counts.get((lang, True), 0))
        wanted[lang, within] = min(1.0, room / n)
    share = F.element_at(F.create_map(*[F.lit(x) for (lang, within), n in wanted.items() for x in (f"{int(within)} {lang}", n)]), F.concat(F.col("inside").cast("int").cast("string"), F.lit(" "), F.col("lang")))
    most = 2 * rows_per_language * len({lang for lang, _ in counts}) + 100
    rows = usable.where(_draw("h") < share).dropDuplicates(["lang", "h"]).orderBy("h").limit(most).collect()
    content: dict[str, bytearray] = {lang: bytearray() for lang, _ in counts}
    for r in sorted(rows, key=lambda r: (r["lang"], not r["inside"], r["h"], r["text"])):
        if len(content[r["lang"]]) < dictionary_bytes:
            content[r["lang"]] += letters(r["text"]) + b" "
    return {k: bytes(v[:dictionary_bytes]).ljust(8) for k, v in sorted(content.items()) if v.strip()}


def _draw(h: str) -> Column:
    """A number from 0 to 1 by a row's hash."""
    return F.pmod(F.col(h), F.lit(1 << 20)) / float(1 << 20)


def learn_margins(
    labelled: DataFrame,
    dictionaries: dict[str, bytes],
    lang_col: str = "lang",
    text_col: str = "text",
    key_col: str = "doc_id",
    most_rows: int | None = None,
    lost: float = 0.001,
    edges: tuple[int, ...] = (0, 40, 160, 640),
) -> dict[int, float]:
    """Number of characters from which it holds -> the margin that is narrow: what a share ``lost`` of rightly named labelled rows of that length don't exceed.

    Learned from all labelled rows (rows that repeat key and text count once), or, where a caller gives ``most_rows``, from about so many, drawn by the hash of key and text from the end that the
    dictionaries are not drawn from first. Margins are counted in cells, of 2^-20 below 1/16, so what comes together for a length is bounded by the cells. Rows
    whose letters their dictionary holds don't count: they stand out as no new text does. Where a length has n rows and n x ``lost`` is under one, the share
    can't be seen: then it is read off a log-normal curve with their mean and deviation, and is their smallest margin at most. Lengths without such a row take over the value of shorter texts; with none at all
    only ties are narrow.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(key_col, text_col).alias("__h"))
    held = usable
    if most_rows is not None:
        n = usable.agg(F.approx_count_distinct("__h")).first()[0]
        held = usable.where(_draw("__h") >= 1 - min(1.0, most_rows / n)) if n else usable
    held = held.dropDuplicates(["__lang", "__h"]).drop("__h")

    @F.pandas_udf("boolean")
    def is_new(langs: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([letters(t[:4000]) not in dictionaries.get(lang, b"") for lang, t in zip(langs, texts)], dtype=bool)

    held = held.where(is_new("__lang", "text"))
    bin_ = F.lit(edges[0])
    for e in edges[1:]:
        bin_ = F.when(F.length("text") >= e, e).otherwise(bin_)
    m, log = F.col("lang_margin"), F.log(F.greatest("lang_margin", F.lit(1e-6)))
    cell = F.when(m < 1 / 16, F.floor(m * (1 << 20))).otherwise((1 << 16) + F.floor(m * 1024))
    named = identify(held, dictionaries).where("lang_pred = __lang").select(bin_.alias("bin"), cell.alias("cell"), m.alias("m"), log.alias("log"))
    cells = named.groupBy("bin", "cell").agg(F.count("*").alias("n"), F.min("m").alias("least"), F.max("m").alias("m"), F.sum("log").alias("log"), F.sum(F.col("log") * F.col("log")).alias("square"))
    n, mean = F.sum("n"), F.sum("log") / F.sum("n")
    deviation = F.sqrt(F.greatest(F.sum("square") - n * mean * mean, F.lit(0.0)) / F.nullif(n - 1, F.lit(0)))
    curve = F.exp(mean + NormalDist().inv_cdf(lost) * deviation)
    narrow = F.when(n * lost < 1, F.least(F.min("least"), F.coalesce(curve, F.lit(0.0)))).otherwise(F.percentile("m", F.lit(lost), F.col("n")))
    found = {r["bin"]: r["m"] for r in cells.groupBy("bin").agg(narrow.alias("m")).collect()}
    out, last = {}, 0.0
    for e in edges:
        out[e] = last = found.get(e, last)
    return out


class Classifier:
    """Sizes under each dictionary. Short texts, and texts with a narrow margin, are encoded again at the slower ``fine_level``, which finds shorter matches."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, fine_level: int, block: int, fine_bytes: int = 512, fine_margin: float = 0.01):
        self.block, self.fine_bytes, self.fine_margin = block, fine_bytes, fine_margin
        self.coarse, self.fine = ([(lang, self.coder(content, lv)) for lang, content in dictionaries.items()] for lv in (level, fine_level))

    @staticmethod
    def coder(content: bytes, level: int):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def sizes(self, data: bytes, coders: list) -> list[tuple[int, str]]:
        blocks = [data[k : k + self.block] for k in range(0, len(data), self.block)]
        return sorted((sum(len(code(b)) for b in blocks), lang) for lang, code in coders)

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin: what the runner-up needs more, as a share of its size."""
        data = letters(text)
        if not data or not self.coarse:
            return UNDETERMINED, 0.0, 0.0
        if len(self.coarse) == 1:
            return self.coarse[0][0], 1.0, 1.0
        sizes = self.sizes(data, self.fine if len(data) <= self.fine_bytes else self.coarse)
        if len(data) > self.fine_bytes and sizes[1][0] - sizes[0][0] <= self.fine_margin * sizes[1][0]:
            sizes = self.sizes(data, self.fine)
        best, second = sizes[0][0], sizes[1][0]
        return sizes[0][1], 1.0 - math.exp(-(second - best) / 4.0), (second - best) / second


def _classified(text_col: str, dictionaries: dict[str, bytes], least_margin: float | dict[int, float], level: int, fine_level: int, block: int) -> tuple[Column, Callable[[Column], Column]]:
    """(language, score and margin of the text in one struct, what tells from that struct whether the text is rejected)."""
    held: list[Classifier] = []  # made once in each task, from the dictionaries it gets

    @F.pandas_udf("lang_pred string, lang_score double, lang_margin double")
    def classify(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(Classifier(dictionaries, level, fine_level, block))
        return pd.DataFrame([held[0](t) for t in texts], columns=["lang_pred", "lang_score", "lang_margin"])

    steps = sorted(least_margin.items()) if isinstance(least_margin, dict) else [(0, least_margin)]
    least = F.lit(float(steps[0][1]))
    for chars, margin in steps[1:]:
        least = F.when(F.length(F.col(text_col).cast("string")) >= chars, F.lit(float(margin))).otherwise(least)
    return classify(F.col(text_col).cast("string")), lambda got: (got["lang_pred"] == UNDETERMINED) | (got["lang_margin"] <= least)


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    text_col: str = "text",
    least_margin: float | dict[int, float] = 0.0,
    level: int = 5,
    fine_level: int = 12,
    block: int = 2048,
) -> DataFrame:
    """``docs`` with columns lang_pred, lang_score, lang_margin and lang_rejected appended.

    Null texts, and texts without a letter, get ``und`` with score 0 and are rejected, as is a text whose margin is not above
    ``least_margin`` (one number, or numbers by the characters from which each holds, see ``learn_margins``). Ties go to the language that sorts first, with margin 0. Whole texts count, in blocks of ``block`` bytes. No
    dictionaries: all ``und``. Clashing columns of the same names are replaced.
    """
    got, rejected = _classified(text_col, dictionaries, least_margin, level, fine_level, block)
    found = docs.withColumn("__tl_named", got)
    got = F.col("__tl_named")
    return found.withColumns({"lang_score": got["lang_score"], "lang_margin": got["lang_margin"], "lang_pred": got["lang_pred"], "lang_rejected": rejected(got)}).drop("__tl_named")


def drop_rejected(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", least_margin: float | dict[int, float] = 0.0, level: int = 5, fine_level: int = 12, block: int = 2048) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects; all columns stay as they are, whatever their names."""
    got, rejected = _classified(text_col, dictionaries, least_margin, level, fine_level, block)
    return docs.withColumn("__tl_named", got).where(~rejected(F.col("__tl_named"))).drop("__tl_named")

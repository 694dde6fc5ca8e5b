"""Documents to training mix: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, langid, mixing, secrets, simhash
from tallyloom.llm.common import fold, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected.

    Null texts, texts without a letter, ties and margins as narrow as one in a thousand of the labelled training rows of like length go. Repeated
    rows share one fate; null ids, languages and sources don't matter. Columns stay as they are. An empty table, or one without any label, gives no rows.
    """
    training = docs.where(fold("doc_id", 4) != 2)
    dictionaries = langid.learn_dictionaries(training)
    margins = langid.learn_margins(training, dictionaries)
    return langid.drop_rejected(docs, dictionaries, least_margin=margins)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: that with the smallest id.

    Null and wordless texts form one group. Rows that repeat id and text stay once; a row with a null id goes if its group has an id, and rows
    with null ids alone all stay but for repeats. Columns stay as they are. An empty table gives no rows.
    """
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, also with other numbers, names or units.

    Null and empty texts stay; items with a null id or text aren't looked for, and with an empty benchmark all rows stay. Repeated rows share
    one fate, null ids are told apart by their text. Columns stay as they are.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows.

    All rows and columns stay, null and empty texts as they are. Secrets of any length in texts of any length are replaced whole.
    """
    model = secrets.train_forest(secrets.labelled_findings(spark))
    clean = secrets.redact(docs, model, path_col="source")
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every document its place in the mix.

    All rows stay; a null source is a source of its own, repeated rows have places of their own. An empty table gives no rows.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
]

ORACLE_SQL = None  # compression, fingerprints and the forest have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

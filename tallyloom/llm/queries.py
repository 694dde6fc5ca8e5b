"""The opN queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codebooks, decontaminate, domtree, langid, licenses, media, merkle, mixing, ngram, secrets, simhash, token_files, warc
from . import oracle as _oracle
from .common import fold, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train_forest(secrets.labelled_findings(spark))
    return secrets.findings(table(spark, sf_dir, "documents"), model, path_col="source")


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(table(spark, sf_dir, "documents"), fold("doc_id", 10) == 0, fold("doc_id", 10) == 1)


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    whole = F.when(F.col("gap_reason").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("archive just written has a gap: "), F.col("gap_reason"))).cast("boolean"))
    return found.where(whole).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "digest_ok")


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.store_media(table(spark, sf_dir, "documents")))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = domtree.train(domtree.labelled_pages())
    return domtree.extract_text(table(spark, sf_dir, "pages"), model)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    dictionaries = langid.learn_dictionaries(docs.where(~held_out))
    margins = langid.learn_margins(docs.where(~held_out), dictionaries)
    found = langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), dictionaries, least_margin=margins)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_margin", "lang_rejected")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


def op13_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash_neardup": op3_simhash_neardup,
    "op4_deleted_interpolation": op4_deleted_interpolation,
    "op5_warc_salvage": op5_warc_salvage,
    "op6_media_chunks": op6_media_chunks,
    "op7_html_main_text": op7_html_main_text,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_pfair_mixing": op10_pfair_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_vector_codes": op12_vector_codes,
    "op13_repair_tokens": op13_repair_tokens,
}
ORACLE: dict[str, str] = dict(_oracle.ORACLE)

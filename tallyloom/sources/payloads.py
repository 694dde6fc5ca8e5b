"""Rows as the JSON that a collector receives, and the text report's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.exprs import truncate_utf8

# Most bytes of each field.
FIELD_BYTES = {"source": 30, "model": 255, "project": 200, "hostname": 255, "error": 300}
GZIP_BYTES = 1024


def iso_seconds(ms: str) -> Column:
    return F.date_format(F.timestamp_millis(F.col(ms)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def normalise_wire(rows: DataFrame, hostname: str | None = None) -> DataFrame:
    """Fields cut to their most bytes between characters; the host stamped on every row if given."""
    out = rows if hostname is None else rows.withColumn("hostname", F.lit(hostname))
    return out.withColumns({c: truncate_utf8(c, n) for c, n in FIELD_BYTES.items() if c in out.columns})


def bucket_payloads(buckets: DataFrame) -> DataFrame:
    return buckets.withColumn("bucket_start", iso_seconds("bucket_start_ms")).drop("bucket_start_ms")


def session_payloads(sessions: DataFrame) -> DataFrame:
    duration = F.greatest(F.floor((F.col("last_ms") - F.col("first_ms")) / 1000), F.lit(0)).cast("long")
    return sessions.withColumns({"first_at": iso_seconds("first_ms"), "last_at": iso_seconds("last_ms"), "duration_seconds": duration}).drop("first_ms", "last_ms")


def json_text(rows: DataFrame, required: list[str], optional: list[str] = []) -> Column:  # noqa: B006
    """An object with keys in the given order; optional fields that are null, zero or empty are left out. <, > and & are escaped."""
    kinds = dict(rows.dtypes)

    def shown(c: str) -> Column:
        if kinds[c].startswith(("map", "array")):
            return F.when(F.size(c) > 0, F.col(c))
        return F.nullif(F.col(c), F.lit("" if kinds[c] == "string" else 0))

    body = F.to_json(F.struct(*[F.col(c) for c in required], *[shown(c).alias(c) for c in optional]))
    for char, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        body = F.replace(body, F.lit(char), F.lit(code))
    return body


def envelopes(buckets: DataFrame, required: list[str], optional: list[str], batch: str = "batch", order: str = "n") -> DataFrame:
    """``(batch, body, gzip)``: a request per batch; batches are cut to their cap before, so an array is small."""
    each = buckets.select(batch, order, json_text(buckets, required, optional).alias("j"))
    body = F.concat(F.lit('{"buckets":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "j"))), lambda x: x["j"]), ","), F.lit("]}"))
    return each.groupBy(batch).agg(body.alias("body")).withColumn("gzip", F.octet_length("body") >= GZIP_BYTES)


def write_requests(requests: DataFrame, path: str) -> None:
    """Bodies as text files, gzipped; one line a request."""
    requests.select("body").write.option("compression", "gzip").text(path)

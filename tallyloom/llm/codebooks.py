"""Vector codes: product quantisation with integer codebooks, the same numbers on any machine.

A component x is floor(4096 * x), so all distances and sums are integers and no order of adding changes them. Each round broadcasts the codebooks, finds the nearest
entry of each part in Arrow batches by |v|^2 - 2 v.c + |c|^2 with int64 matrix products, and merges the entries' sums and counts by a grouped shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_split, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
MOST = 1 << 26  # of a component's magnitude: squared distances of 128 such components fit in 63 bits
BROADCAST_ROWS = 300_000
Codebooks = np.ndarray  # int64 [part, entry, position]


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(vec_id, label, v array<long>)`` of the rows whose vector isn't null and holds only finite numbers, stored in the shared folder."""
    vec = F.col(vec_col).cast("array<double>")
    kept = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vec.alias("x")).where("x is not null and not exists(x, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    floor = F.transform("x", lambda c: F.when(F.abs(c) < MOST / SCALE, F.floor(c * SCALE)).otherwise(F.raise_error(F.lit(f"vector components beyond {MOST // SCALE} can't be squared exactly"))))
    return stored(kept.select("vec_id", "label", floor.cast("array<long>").alias("v")), "vectors")


def as_matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows of one matrix, short ones padded by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def nearest(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each vector's parts, two matrices [vector, part]; of equally near entries the first."""
    parts, _, width = books.shape
    codes, errors = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for p in range(parts):
        v, c = x[:, p * width : (p + 1) * width], books[p]
        apart = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)
        codes[:, p] = apart.argmin(1)
        errors[:, p] = apart[np.arange(len(x)), codes[:, p]]
    return codes, errors


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids, of repeated ids that with the smallest components; null ids come last. Collects ``entries`` rows."""
    width = max(1, -(-(vectors.agg(F.max(F.size("v"))).first()[0] or 0) // parts))
    first = vectors.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.zeros((len(first), parts * width), np.int64)
    for k, r in enumerate(first):
        books[k, : len(r["v"])] = r["v"]
    return books.reshape(len(first), parts, width).transpose(1, 0, 2).copy()


def merge_round(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: each entry the floored mean of the parts that are nearest to it, unused entries as they were."""
    parts, entries, width = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, total, count = sent.value, np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = as_matrix(batch.column(0), parts * width)
            codes, _ = nearest(x, books)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], x[:, p * width : (p + 1) * width])
                count[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = vectors.select("v").mapInArrow(sums, "part int, entry int, n long, sums array<long>")
    each = found.select("part", "entry", "n", F.posexplode("sums").alias("position", "s"))
    merged = each.groupBy("part", "entry", "position").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    books = books.copy()
    for r in merged.collect():  # parts x entries x width rows at most
        books[r["part"], r["entry"], r["position"]] = int(r["s"]) // r["n"]
    sent.unpersist()
    return books


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = merge_round(vectors, books)
    return books


def codebooks_text(books: Codebooks) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``(vec_id, label, code, error)``: two hex digits a part, and the squared distance to what the code stands for."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.shape
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = nearest(as_matrix(batch.column(2), parts * width), sent.value)
            text = [bytes(row).hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(errors.sum(1))], ["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {label}, code string, error long")


def decode(code: str, books: Codebooks) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(code))])


def compress(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``, one row per row with a whole vector.

    Rows whose vector is null or has a null or non-finite component have none. Vectors shorter than the longest, or than a positive multiple of ``parts``, count as padded with
    zeros to that length; components from 16,384 on raise an error, as their squares would not be exact. Null ids are coded like others but come last when the codebooks are begun; repeated rows
    are coded each. Fewer vectors than ``entries`` make smaller codebooks. Null labels are one label. Other columns don't count, and an empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    vectors = integer_vectors(rows, id_col, vec_col, label_col)
    books = train(vectors, parts, entries, rounds)
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    coded = stored(encode(vectors, books), "vector-codes").withColumn("mark", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-")))
    sums = stored(coded.groupBy("mark").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "label-errors")
    if sums.count() <= BROADCAST_ROWS:
        joined = coded.join(F.broadcast(sums), "mark")
    else:
        joined = join_split(coded, sums, "mark", "rows", coded.count())
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

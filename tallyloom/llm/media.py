"""Media columns stored as content-defined chunks.

A media file is cut where a rolling gear hash of its last 32 bytes has its top bits zero. Chunk digests are deduplicated by Spark joins:
of equal chunks one document keeps the bytes, the others keep the digest in their ordered chunk list. Reading back
fetches the missing chunks by digest, puts the list together in order and verifies every digest.

Only digests are shuffled to find equal chunks, and only shared chunks to read documents back; all other bytes stay with their row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_split, shared_dir, stored

GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 2024) for b in range(256)], np.uint32)
ROW = 192  # bytes in a pixel row: 64 pixels of three 8-bit samples
REFS_PER_SALT = 128
MOST_SALTS = 1 << 14  # copies of one chunk that are sent out, 128 MB of a chunk of the largest size


def cuts(data: bytes, least: int = 512, bits: int = 11, most: int = 8192) -> list[int]:
    """Ends of the chunks: ``least`` to ``most`` bytes each (the last may be shorter), about least + 2^bits on average."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s] << np.uint32(s)
    marks = np.nonzero((h >> np.uint32(32 - bits)) == 0)[0] + 1
    out, start, k = [], 0, 0
    marks = marks.tolist()
    while start < n:
        while k < len(marks) and marks[k] < start + least:
            k += 1
        end = marks[k] if k < len(marks) and marks[k] <= start + most else start + most
        end = min(end, n)
        out.append(end)
        start = end
    return out


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(digest, bytes) in order."""
    start = 0
    for end in cuts(data):
        piece = data[start:end]
        yield hashlib.sha256(piece).digest(), piece
        start = end


def encode_ppm(payload: bytes) -> bytes:
    """The payload, a positive multiple of 192 bytes, as a binary PPM picture 64 pixels wide."""
    return b"P6\n64 %d\n255\n" % (len(payload) // ROW) + payload


def decode_ppm(media: bytes) -> bytes:
    magic, size, depth, payload = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P6" or depth != b"255" or width * height * 3 != len(payload):
        raise ValueError("not one of our pictures")
    return payload


def text_payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b" " * (-len(data) % ROW or (0 if data else ROW))


def describe(payload: bytes) -> str:
    """Mean and deviation of the samples, their entropy in bits, and the mean step between neighbouring pixel rows."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, values = len(payload), np.arange(256)
    mean = int((counts * values).sum()) / n
    spread = max(0.0, int((counts * values * values).sum()) / n - mean * mean) ** 0.5
    share = counts[counts > 0] / n
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW).astype(np.int32)
    step = int(np.abs(np.diff(rows, axis=0)).sum()) / max(1, n - ROW)
    return f"mean={mean:.3f};sd={spread:.3f};entropy={float(-(share * np.log2(share)).sum()):.3f};step={step:.3f}"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


PARTS = "array<struct<digest:binary,len:int,salts:int,bytes:binary>>"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 300_000) -> DataFrame:
    """Stores every row's media in chunks and returns the store, ``(uid, id, n_bytes, missing, parts)``, read from the shared folder.

    parts is the ordered chunk list; bytes is null where another row keeps that chunk, ``missing`` counts those. ``salts`` is 0 for a chunk that occurs once, else the number of
    keys over which its readers are spread. Null texts are empty; rows with null ids and repeated rows are
    stored like others. Above ``broadcast_rows`` rows and marks of shared chunks, they are joined by a shuffle and not by broadcast.
    """
    rows = _rows(docs, id_col, text_col)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[d for d, _ in chunks(encode_ppm(text_payload(t)))] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.binary()))], ["id", "th", "digests"])

    listed = stored(rows.mapInArrow(digests, "id long, th long, digests array<binary>"), "digests")
    each = listed.select("id", "th", F.posexplode("digests").alias("seq", "digest"))
    owner = F.min(F.struct("id", "th", "seq")).alias("owner")
    shared = each.groupBy("digest").agg(F.count("*").alias("n"), owner).where("n > 1")
    salts = F.least(F.ceil(F.col("n") / REFS_PER_SALT), F.lit(MOST_SALTS)).cast("int")
    shared = stored(shared.select("digest", "n", salts.alias("salts"), "owner"), "shared")
    total = listed.agg(F.coalesce(F.sum(F.size("digests")), F.lit(0))).first()[0]
    own = F.struct("id", "th", "seq").eqNullSafe(F.col("owner"))
    marks = join_split(each, shared, "digest", "n", total).groupBy("id", "th").agg(F.collect_set(F.struct("seq", own.alias("keeps"), "salts")).alias("marks"))
    marks = stored(marks.select(F.col("id").alias("mid"), F.col("th").alias("mth"), "marks"), "marks")
    size = marks.agg(F.count("*") + F.coalesce(F.sum(F.size("marks")), F.lit(0))).first()[0]
    side = F.broadcast(marks) if size <= broadcast_rows else marks.hint("merge")
    joined = rows.join(side, F.col("id").eqNullSafe(F.col("mid")) & (F.col("th") == F.col("mth")), "left").select("id", "text", "marks")
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("len", pa.int32()), ("salts", pa.int32()), ("bytes", pa.binary())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                n_bytes, missing, parts = [], [], []
                for text, marked in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    at = {m["seq"]: m for m in marked or ()}
                    payload = text_payload(text)
                    row = []
                    for seq, (digest, piece) in enumerate(chunks(encode_ppm(payload))):
                        m = at.get(seq)
                        row.append({"digest": digest, "len": len(piece), "salts": m["salts"] if m else 0, "bytes": piece if m is None or m["keeps"] else None})
                    n_bytes.append(len(text.encode()))
                    missing.append(sum(p["bytes"] is None for p in row))
                    parts.append(row)
                uids = pa.array(range(uid, uid + part.num_rows), pa.int64())
                uid += part.num_rows
                yield pa.RecordBatch.from_arrays([uids, part.column(0), pa.array(n_bytes, pa.int64()), pa.array(missing, pa.int32()), pa.array(parts, kind)], ["uid", "id", "n_bytes", "missing", "parts"])

    store = joined.mapInArrow(cut, f"uid long, id long, n_bytes long, missing int, parts {PARTS}")
    path = shared_dir(docs.sparkSession, "media")
    store.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(store.schema).parquet(path)


def assemble(store: DataFrame, broadcast_rows: int = 300_000) -> DataFrame:
    """``(id, n_bytes, parts)``: the store with every chunk list complete. Only rows that lack a chunk are shuffled."""
    parts = "array<struct<seq:int,digest:binary,bytes:binary>>"
    whole = store.where("missing = 0").select("id", "n_bytes", F.transform("parts", lambda p, i: F.struct(i.alias("seq"), p["digest"].alias("digest"), p["bytes"].alias("bytes"))).cast(parts).alias("parts"))
    pieces = store.where("missing > 0").select("uid", "id", "n_bytes", F.posexplode("parts").alias("seq", "p"))
    present = pieces.where("p.bytes is not null").select("uid", "id", "n_bytes", "seq", F.col("p.digest").alias("digest"), F.col("p.bytes").alias("bytes"))
    absent = pieces.where("p.bytes is null").select("uid", "id", "n_bytes", "seq", F.col("p.digest").alias("digest"), F.pmod(F.xxhash64("uid"), F.col("p.salts")).alias("salt"))
    held = store.select("uid", F.explode(F.filter("parts", lambda p: (p["salts"] > 0) & p["bytes"].isNotNull())).alias("p"))
    # repeats of the owner's row keep the chunk as well: one of them, the least uid, gives it out
    several = held.groupBy(F.col("p.digest").alias("digest")).agg(F.min("uid").alias("giver"), F.count("*").alias("holders")).where("holders > 1")
    several = stored(several.select("digest", "giver"), "givers")
    n = several.count()
    kept = held.join(F.broadcast(several) if n <= broadcast_rows else several.hint("merge"), F.col("p.digest") == F.col("digest"), "left").where("giver is null or giver = uid").select("p") if n else held
    kept = kept.select(F.col("p.digest").alias("digest"), F.col("p.bytes").alias("bytes"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("p.salts").cast("long") - 1)).alias("salt"))
    fetched = absent.join(kept, ["digest", "salt"]).select("uid", "id", "n_bytes", "seq", "digest", "bytes")
    lists = present.unionByName(fetched).groupBy("uid", "id", "n_bytes").agg(F.collect_list(F.struct("seq", "digest", "bytes")).cast(parts).alias("parts"))
    return whole.unionByName(lists.select("id", "n_bytes", "parts"))


def read_media(store: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per stored row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, verified.

    All but n_bytes are computed from the bytes read back; verified tells that every chunk has its digest.
    """
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, verified boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                pieces = sorted((p["seq"], p["digest"], p["bytes"]) for p in batch.column(2)[k].as_py())
                ordered = [(d, b) for _, d, b in pieces]
                media = b"".join(b for _, b in ordered)
                payload = decode_ppm(media)
                good = all(hashlib.sha256(b).digest() == d for d, b in ordered)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(payload), good))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    return assemble(store).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restore(spark: SparkSession, store: DataFrame) -> DataFrame:
    """``(id, media)``: the whole files, put together from their chunks."""
    ordered = F.array_sort(F.col("parts"), lambda a, b: a["seq"] - b["seq"])
    return assemble(store).select("id", F.aggregate(ordered, F.lit(b""), lambda acc, p: F.concat(acc, p["bytes"])).alias("media"))

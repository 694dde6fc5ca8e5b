"""WARC archives: a writer that deduplicates payloads, and a reader that salvages damaged files.

Records are written as gzip members, one per record, into files of bounded size in shared storage. The reader walks each file. Where a
member or record fails its checks it looks for the next place where a valid member or a version line begins, recovers what
follows, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_split, shared_dir, stored

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
MOST_HEADERS = 1 << 20
EPOCH = "1970-01-01T00:00:00Z"  # records carry no crawl time: equal input gives equal archives
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(kind: str, uri: str, record_id: str, block: bytes, digest: str, more: dict[str, str]) -> bytes:
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{record_id}>",
        "WARC-Date": EPOCH,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
        **more,
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


class Damaged(ValueError):
    pass


class Scan:
    """Finds a byte string from a place on; places asked for must not fall, so all calls together read the data once."""

    def __init__(self, data: bytes, what: bytes):
        self.data, self.what, self.found = data, what, -1

    def next(self, at: int) -> int:
        """The first place at or after ``at``; the data's length if there is none."""
        if at > self.found:
            k = self.data.find(self.what, at)
            self.found = k if k >= 0 else len(self.data)
        return self.found


def parse_record(data: bytes, at: int, blanks: Scan) -> tuple[Record, int]:
    """The record that begins at ``at`` and where it ends; raises Damaged unless all of its checks hold. ``blanks`` finds the data's blank lines."""
    if not data.startswith(VERSION, at):
        raise Damaged("no version line")
    end = blanks.next(at)
    if end == len(data) or end - at > MOST_HEADERS:
        raise Damaged("headers do not end")
    headers: dict[str, str] = {}
    line = data.find(b"\r\n", at)
    while line < end:
        start, line = line + 2, data.find(b"\r\n", line + 2)
        name, colon, value = data[start:line].decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("header without a colon")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit() and len(size) < 19):
        raise Damaged("no content length")
    start = end + 4
    stop = start + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("block does not end where its length says")
    block = data[start:stop]
    wanted = headers.get("warc-block-digest", "")
    if wanted.startswith("sha1:") and wanted[5:] != sha1_base32(block):
        raise Damaged("block digest differs")
    return Record(headers, block), stop + 4


def inflate_member(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """(what could be inflated, where the member ends or inflating failed, the reason of a failure or nothing)."""
    z, out, pos, step = zlib.decompressobj(31), [], at, 65536
    while not z.eof and pos < len(data):
        before = z.copy()
        piece = data[pos : pos + step]
        try:
            out.append(z.decompress(piece))
            pos += len(piece)
        except zlib.error as e:
            if len(piece) == 1:
                return b"".join(out), pos, f"gzip: {e}"
            z, step = before, max(1, step // 16)  # the bytes before the failure count
    if not z.eof:
        return b"".join(out), pos, "gzip member is cut off"
    return b"".join(out), pos - len(z.unused_data), ""


def in_member(plain: bytes, at: int, end: int) -> Iterator[tuple[int, int, Record | None, str]]:
    """Records of one inflated member; a damaged one is skipped up to the next version line and logged with the member's range."""
    pos, blanks = 0, Scan(plain, b"\r\n\r\n")
    while pos < len(plain):
        try:
            record, pos = parse_record(plain, pos, blanks)
            yield at, end, record, ""
        except Damaged as e:
            yield at, end, None, f"in member: {e}"
            pos = plain.find(VERSION, pos + 1)
            if pos < 0:
                return


def salvage(raw: bytes) -> Iterator[tuple[int, int, Record | None, str]]:
    """(offset, end, record or None, reason): every recoverable record, and every gap with the reason of its first failure.

    Records are also taken from what a failing member gave before it failed: each is checked by its own length and digest, and the range of the failing
    member is logged with the reason. Behind a failure the next start is looked for from the member's second byte on, as the failing member may have run into the next one;
    up to where inflating failed only members count, since version lines there were read already.
    """
    data, at, gap, why, read = memoryview(raw), 0, -1, "", 0
    members, lines, blanks = Scan(raw, MAGIC), Scan(raw, VERSION), Scan(raw, b"\r\n\r\n")
    while at < len(raw):
        found: list[tuple[int, int, Record | None, str]] = []
        if raw.startswith(MAGIC, at):
            plain, end, failure = inflate_member(data, at)
            found = list(in_member(plain, at, end))
            if failure:
                found = [r for r in found if r[2] is not None]
                read = max(read, end if found else at + 1)
        else:
            failure = ""
            try:
                record, end = parse_record(raw, at, blanks)
                found = [(at, end, record, "")]
            except Damaged as e:
                failure = str(e)
        if failure:
            if found and gap >= 0:  # what lies before is a gap of its own
                yield gap, at, None, why
                gap = -1
            if gap < 0:
                gap, why = at, failure
            yield from found
            at = min(members.next(at + 1), lines.next(max(at + 1, read)))
            continue
        if gap >= 0:
            yield gap, at, None, why
            gap = -1
        yield from found
        at = end
    if gap >= 0:
        yield gap, len(raw), None, why


def decide_types(pages: DataFrame, key_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """``(key, digest, refers_to)`` of the rows that revisit another row's payload, one row per key and payload. Digests, not payloads, are shuffled."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    sums = pages.select(F.col(key_col).cast("long").alias("key"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n"))
    sums = stored(sums.where(F.col("n") >= least_bytes).select("key", "digest"), "warc-digests")
    groups = sums.groupBy("digest").agg(F.min("key").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1")
    revisits = join_split(sums, stored(groups, "warc-groups"), "digest", "rows", sums.count()).where("not key <=> refers_to")
    return revisits.groupBy("key", "digest").agg(F.first("refers_to").alias("refers_to"))


def write_archives(
    pages: DataFrame,
    path: str,
    key_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    file_bytes: int = 32 << 20,
    broadcast_rows: int = 300_000,
) -> DataFrame:
    """Writes one record per row below ``path`` and returns ``(file, records, bytes)``, the manifest, as a lazy
    DataFrame: each run writes files anew.

    Among rows with equal payloads of at least ``least_bytes`` bytes, that with the smallest key is a response and the others are
    revisits that refer to it; rows that repeat this key are responses too, and so are all rows of a group in which every key is null. Null payloads are empty, null urls are ``urn:none``.
    A file closes once it holds ``file_bytes``, so a reader's task stays small. Up to ``broadcast_rows`` revisits are broadcast to the rows, so payloads
    stay where they are; more are joined by a shuffle.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), payload.cast("binary").alias("payload"))
    # join by key and digest: the digest keeps rows apart that repeat a key with another payload
    rows = rows.withColumn("digest", F.sha1("payload"))
    types = stored(decide_types(pages, key_col, payload_col, least_bytes), "warc-types")
    types = F.broadcast(types) if types.count() <= broadcast_rows else types
    joined = rows.join(types.select(F.col("key").alias("k"), F.col("digest").alias("d"), F.col("refers_to")), F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left")
    joined = joined.select("key", "url", "payload", F.col("refers_to"), F.col("d").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        part, attempt, number, out, held, done = context.partitionId(), context.taskAttemptId(), 0, io.BytesIO(), 0, []

        def close() -> None:
            nonlocal number, out, held
            if held:
                final = f"{base}/part-{part:06d}-{number:04d}-{attempt}.warc.gz"  # the manifest names those of attempts that succeeded
                with fs.open_output_stream(final, compression=None) as f:  # the members are the compression
                    f.write(out.getbuffer())
                done.append((final.rpartition("/")[2], held, out.tell()))
            number, out, held = number + 1, io.BytesIO(), 0

        for batch in batches:
            for key, url, data, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                kind = "revisit" if revisit else "response"
                digest = sha1_base32(data)
                own = uuid.uuid5(uuid.NAMESPACE_URL, f"{key}/{digest}")
                more = {"X-Page-Id": None if key is None else str(key), "X-Payload-Length": str(len(data))}
                if revisit:
                    more |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}/{digest}')}>", "X-Refers-To-Page": str(refers_to)}
                clean = " ".join((url or "urn:none").split())
                out.write(member(build_record(kind, clean, str(own), b"" if revisit else data, digest, more)))
                held += 1
                if out.tell() >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    return joined.mapInArrow(run, "file string, records long, bytes long")


RECORD_SCHEMA = "file string, offset long, end long, record_type string, target_uri string, page_id long, payload_digest string, payload_bytes long, refers_to long, payload binary, digest_ok boolean, gap_reason string"


def read_archives(spark: SparkSession, path: str, files: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives named in ``files.file`` below ``path``; if ``files`` states their ``records``, a file that gives another number of them has one more gap row at its end.

    A row with gap_reason is a quarantined range [offset, end) of its file; all other rows are records. For a response, payload_bytes and
    payload_digest are measured on the payload that was read; for a revisit they are those its headers state. digest_ok tells whether
    the payload has the digest that the record states. An empty file has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        names = [x.strip().split()[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.string()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        number = lambda x: int(x) if x and x.lstrip("-").isdigit() else None
        for batch in batches:
            for name, stated_records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    raw = f.read()
                rows, held, good = [], 0, 0
                for offset, end, record, why in salvage(raw):
                    good += record is not None
                    if record is None:
                        rows.append((name, offset, end, *[None] * 7, None, why))
                        continue
                    h = record.headers
                    kind, stated = h.get("warc-type", ""), h.get("warc-payload-digest", "").removeprefix("sha1:")
                    body = kind != "revisit"
                    digest = sha1_base32(record.block) if body else stated
                    size = len(record.block) if body else number(h.get("x-payload-length"))
                    rows.append((name, offset, end, kind, h.get("warc-target-uri"), number(h.get("x-page-id")), digest, size, number(h.get("x-refers-to-page")), record.block if body and keep_payload else None, digest == stated, None))
                    held += len(record.block) if keep_payload else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pack(rows)
                        rows, held = [], 0
                if stated_records is not None and good != stated_records:
                    rows.append((name, len(raw), len(raw), *[None] * 8, f"the manifest states {stated_records} records, {good} were read"))
                if rows:
                    yield pack(rows)

    n = files.count()
    files = files if "records" in files.columns else files.withColumn("records", F.lit(None))
    return files.select("file", F.col("records").cast("long")).repartition(max(1, min(n, 20_000))).mapInArrow(run, RECORD_SCHEMA)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes ``pages`` to fresh archives in the shared folder and returns what the reader finds there."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    manifest = shared_dir(spark, "warc-files")
    write_archives(pages, path, **columns).write.parquet(manifest)
    files = spark.read.schema("file string, records long, bytes long").parquet(manifest)
    return read_archives(spark, path, files, keep_payload=False)

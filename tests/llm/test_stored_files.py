"""Archives and media as they lie on disk: damage, cuts, members of many records, repeated rows."""

from __future__ import annotations

import glob
import gzip
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import common, media, queries, warc


def archives(spark, n=40, **options):
    rng = random.Random(4)
    rows = [(k, f"http://h/{k}", " ".join(f"w{rng.randrange(5000)}" for _ in range(200))) for k in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = common.shared_dir(spark, "archives")
    files = warc.write_archives(pages, path, **options)
    manifest = common.stored(files, "manifest")
    return rows, path, manifest, sorted(glob.glob(path.removeprefix("file://") + "/*.warc.gz"))


def change(path, f):
    raw = bytearray(open(path, "rb").read())
    raw = f(raw) or raw
    open(path, "wb").write(raw)
    return bytes(raw)


def test_plain_member_walk_reads_the_archives(spark):
    rows, _, manifest, (name,) = archives(spark)
    raw, seen = open(name, "rb").read(), []
    assert manifest.first()["bytes"] == len(raw)
    while raw:  # any reader of gzip members finds one record in each
        z = zlib.decompressobj(31)
        seen.append(z.decompress(raw))
        assert seen[-1].startswith(b"WARC/1.1\r\n") and seen[-1].endswith(b"\r\n\r\n")
        raw = z.unused_data
    assert [s.split(b"\r\n\r\n", 1)[1][:-4].decode() for s in seen] == [t for *_, t in rows]
    assert gzip.decompress(open(name, "rb").read()) == b"".join(seen)


def test_damage_on_disk_is_salvaged_and_logged(spark):
    rows, path, manifest, (name,) = archives(spark)
    size = len(open(name, "rb").read())

    def zero(raw):
        raw[size // 2 : size // 2 + 20] = bytes(20)

    change(name, zero)
    got = warc.read_archives(spark, path, manifest).collect()
    good = [r for r in got if r["gap_reason"] is None]
    assert len(good) in (38, 39) and all(r["digest_ok"] for r in good)
    assert {(r["page_id"], r["payload"].decode()) for r in good} <= {(k, t) for k, _, t in rows}
    assert any(r["gap_reason"].startswith("the manifest states 40 records") for r in got if r["gap_reason"])
    change(name, lambda raw: raw[: size // 2])
    cut = warc.read_archives(spark, path, manifest).collect()
    assert 15 < sum(r["gap_reason"] is None for r in cut) < 25 and any("cut off" in (r["gap_reason"] or "") for r in cut)


def test_file_cut_at_a_members_end_is_noticed(spark, monkeypatch):
    _, path, manifest, (name,) = archives(spark)
    raw = open(name, "rb").read()
    change(name, lambda b: b[: raw.rindex(warc.MAGIC)])
    got = warc.read_archives(spark, path, manifest)
    assert [r["gap_reason"] for r in got.where("gap_reason is not null").collect()] == ["the manifest states 40 records, 39 were read"]
    assert warc.read_archives(spark, path, manifest.select("file")).where("gap_reason is not null").count() == 0
    monkeypatch.setattr(warc, "round_trip", lambda pages: got)
    monkeypatch.setattr(queries, "table", lambda *_: None)
    with pytest.raises(Exception, match="39 were read"):
        queries.op5_warc_salvage(spark, "").collect()


def test_members_of_many_records_give_all_that_check_out():
    rng = random.Random(3)
    blocks = [bytes(rng.choice(b"abcdefgh ") for _ in range(400)) + bytes([48 + k]) for k in range(20)]
    records = [warc.build_record("response", "u", f"id{k}", b, warc.sha1_base32(b), {"X-Page-Id": str(k)}) for k, b in enumerate(blocks)]
    whole = warc.member(b"".join(records))
    after = warc.member(records[0])
    ids = lambda raw: [int(r.headers["x-page-id"]) for _, _, r, _ in warc.salvage(raw) if r]
    assert ids(whole) == list(range(20))
    assert ids(whole[:-4] + b"\0\0\0\0" + after) == [*range(20), 0]  # its check sums
    assert ids(whole[:-100]) == list(range(19)) and ids(whole[:-100] + after) == [*range(19), 0]
    middle = bytearray(whole)
    middle[len(whole) // 2] ^= 255
    found = ids(bytes(middle) + after)
    assert found[:9] == list(range(9)) and found[-1] == 0 and len(set(found)) >= 10
    assert sum(r is None for *_, r, _ in warc.salvage(bytes(middle) + after)) >= 1
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)  # records lie plainly in the file: none may come twice
    plain = stored.compress(b"".join(records)) + stored.flush()
    assert ids(plain[:-4] + b"\0\0\0\0") == list(range(20))


def test_salvage_is_linear_in_version_lines():
    raw = b"WARC/1.1\r\nA: b\r\n" * (1 << 16)  # 1 MB without an end of headers
    start = time.perf_counter()
    assert [(a, b, r) for a, b, r, _ in warc.salvage(raw)] == [(0, len(raw), None)]
    assert time.perf_counter() - start < 3
    assert [r for *_, r, _ in warc.salvage(b"WARC/1.1\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\n")] == [None]


def test_repeated_rows_fetch_each_chunk_once(spark):
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(9000)}" for _ in range(60))
    rows = [(None, text)] * 400 + [(k, text) for k in range(400)]
    store = media.store_media(spark.createDataFrame(rows, "doc_id long, text string"))
    lists = media.assemble(store)
    n = len(media.cuts(media.encode_ppm(media.text_payload(text))))
    assert lists.agg(F.sum(F.size("parts"))).first()[0] == 800 * n and lists.count() == 800
    assert media.assemble(store, broadcast_rows=0).agg(F.sum(F.size("parts"))).first()[0] == 800 * n
    got = media.read_media(store)
    assert got.where("verified").count() == 800 and got.select("media_sha256").distinct().count() == 1

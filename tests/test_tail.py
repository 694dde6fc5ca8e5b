"""The live tail: files that grow, are cut and replaced between batches and over restarts."""

from __future__ import annotations

import json
import os
import random
import time

import pytest

from tallyloom.streaming import tail


class Tail:
    def __init__(self, spark, tmp, **options):
        self.spark, self.tmp, self.root = spark, tmp, str(tmp / "logs")
        self.options = {"discoverSeconds": 0} | options
        os.makedirs(self.root, exist_ok=True)

    def start(self):
        lines = tail.tail_lines(self.spark, [self.root], str(self.tmp / "state"), **self.options)
        self.query = lines.writeStream.format("parquet").option("path", str(self.tmp / "out")).option("checkpointLocation", str(self.tmp / "cp")).start()
        return self

    def step(self):
        self.query.processAllAvailable()

    def stop(self):
        self.query.stop()

    def rows(self):
        rows = self.spark.read.schema(tail.SCHEMA).parquet(str(self.tmp / "out")).collect()
        return sorted((os.path.relpath(r["path"], self.root), r["offset"], r["raw"], r["history"]) for r in rows)

    def put(self, name, text, mode="a"):
        path = os.path.join(self.root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, mode + "b") as f:
            f.write(text.encode())
        return path


def test_lines_come_once_over_appends_cuts_replacements_and_restarts(spark, tmp_path):
    t = Tail(spark, tmp_path)
    t.put("a.jsonl", '{"n":1}\n{"n":2}\n{"n"')
    t.put("deep/b.JSONL", "é\r\n\n  \nx\n")
    for name in ("summary-1.jsonl", "live-rate.jsonl", "subagents/c.jsonl", "other.txt", "empty.jsonl"):
        t.put(name, "" if name.startswith("empty") else "no\n")
    t.start().step()
    first = [("a.jsonl", 0, '{"n":1}', True), ("a.jsonl", 8, '{"n":2}', True), ("deep/b.JSONL", 0, "é", True), ("deep/b.JSONL", 8, "x", True)]
    assert t.rows() == first
    t.put("a.jsonl", ":3}\n{}\n")
    t.put("new.jsonl", "one\n")
    t.step()
    grown = [("a.jsonl", 16, '{"n":3}', False), ("a.jsonl", 24, "{}", False), ("new.jsonl", 0, "one", True)]
    assert t.rows() == sorted(first + grown)
    t.stop()
    t.put("a.jsonl", "while stopped\n")
    t.put("new.jsonl", "uno\nzwei\ntres\n", "w")  # replaced by something longer
    t.put("deep/b.JSONL", "cut\n", "w")  # and by something shorter
    t.start().step()
    late = [("a.jsonl", 27, "while stopped", False), ("deep/b.JSONL", 0, "cut", False), ("new.jsonl", 0, "uno", False), ("new.jsonl", 4, "zwei", False), ("new.jsonl", 9, "tres", False)]
    assert t.rows() == sorted(first + grown + late)
    t.step()
    t.stop()
    t.start().step()
    t.stop()
    assert t.rows() == sorted(first + grown + late)


def test_random_appends_in_any_batching(spark, tmp_path):
    rng, wanted = random.Random(1), {}
    t = Tail(spark, tmp_path, maxBytes=200).start()
    for k in range(12):
        for _ in range(rng.randrange(4)):
            name = f"f{rng.randrange(3)}.jsonl"
            lines = ["".join(rng.choice("abcé") for _ in range(rng.choice([3, 40, 600]))) for _ in range(rng.randrange(1, 5))]
            wanted.setdefault(name, []).extend(lines)
            t.put(name, "\n".join(lines) + "\n")
        t.step()
        if k % 4 == 3:
            t.stop()
            t.start()
    t.step()
    t.stop()
    got = {}
    for name, _, raw, _ in t.rows():
        got.setdefault(name, []).append(raw)
    assert got == wanted


def test_old_files_wait_and_go_on_where_they_were(spark, tmp_path):
    t = Tail(spark, tmp_path, recentSeconds=60, keepSeconds=60, maxFiles=2)
    old = t.put("old.jsonl", "past\n")
    os.utime(old, (time.time() - 300,) * 2)
    paths = [t.put(f"f{k}.jsonl", f"l{k}\n") for k in range(3)]
    for k, p in enumerate(paths):
        os.utime(p, (time.time() - 30 + k,) * 2)
    t.start().step()
    assert [r[2] for r in t.rows()] == ["l1", "l2"]  # the two newest
    t.stop()
    for p in paths[1:]:
        os.utime(p, (time.time() - 300,) * 2)
    state = str(tmp_path / "state" / "known.json")
    known = json.load(open(state))
    for e in known.values():  # as if they had been read long ago
        e["seen"] -= 300
    json.dump(known, open(state, "w"))
    t.start().step()
    t.put("f1.jsonl", "more\n")
    t.step()
    t.step()
    t.stop()
    assert [r[2] for r in t.rows() if r[0] == "f1.jsonl"] == ["l1", "more"] and not any(r[0] == "old.jsonl" for r in t.rows())


@pytest.mark.parametrize(("text", "most", "ends"), [("ab\ncd\nef", 100, [6, 6]), ("ab\ncd\nef", 4, [3, 6, 6]), ("abcdefgh\ni\n", 3, [9, 11]), ("", 5, [0]), ("abc", 2, [0]), ("\n\n\n", 1, [1, 2, 3])])
def test_whole_lines_within_a_bound(tmp_path, monkeypatch, text, most, ends):
    monkeypatch.setattr(tail, "BLOCK", 2)
    p = tmp_path / "x.jsonl"
    p.write_text(text)
    files, at, got = tail.Files(str(tmp_path)), 0, []
    for _ in ends:
        at = tail.whole_lines(files, str(p), at, len(text), most)
        got.append(at)
    assert got == ends


def test_a_file_replaced_after_planning_is_left_to_the_next_batch(tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text("one\ntwo\n")
    reader = tail.TailReader({"path": str(tmp_path), "discoverSeconds": "0"})
    end = reader.latestOffset()
    (piece,) = reader.partitions(reader.initialOffset(), end)
    p.write_text("uno\ndos\ntres\n")
    assert list(reader.read(piece)) == []
    later = reader.latestOffset()
    (piece,) = reader.partitions(end, later)
    assert [b.column(2).to_pylist() for b in reader.read(piece)] == [["uno", "dos", "tres"]]
    assert reader.latestOffset() == later and reader.partitions(later, later) == []
    p.unlink()
    assert reader.latestOffset() == {"files": {}}

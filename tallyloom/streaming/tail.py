"""A stream source that follows growing JSONL files by byte offset.

An offset says of each followed file how far whole lines were read, a guard (the bytes before that place) and a mark of the file's head. A batch reads the lines between two such
places, a task per file and at most ``maxBytes`` of it; a line that isn't ended yet waits. Where guard or head no longer hold, the file was cut or replaced and is read
from its start. Only offsets pass through the driver; the tasks read the bytes, so the folders must be mounted on all machines, or be in a store that pyarrow opens.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# What is followed, how many files, and for how long
NOT_FOLLOWED = ("summary", "aggregate", "snapshot", "live-rate", "live_rate")
NOT_ENTERED = "subagents"
RECENT_SECONDS, KEEP_SECONDS, DISCOVER_SECONDS, MOST_FILES, MOST_BYTES, GUARD = 900, 1800, 10, 96, 512 * 1024, 64

FORGET_SECONDS = 7 * 86_400
BLOCK = 1 << 16
SCHEMA = "path string, offset long, raw string, history boolean"


def followed(path: str) -> bool:
    """Whether a file belongs to the live tail by its name: JSONL, no summary of other files, no sub-agent transcript."""
    parts = path.lower().split("/")
    return parts[-1].endswith(".jsonl") and NOT_ENTERED not in parts and not any(w in parts[-1] for w in NOT_FOLLOWED)


class Files:
    """Sizes and byte ranges of files below a root, by paths relative to nothing: as the file system names them."""

    def __init__(self, root: str):
        self.fs, self.base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)

    def listing(self) -> list[pafs.FileInfo]:
        found = self.fs.get_file_info(pafs.FileSelector(self.base, recursive=True, allow_not_found=True))
        return [f for f in found if f.type == pafs.FileType.File]

    def info(self, path: str) -> pafs.FileInfo:
        return self.fs.get_file_info(path)

    def read(self, path: str, start: int, stop: int) -> bytes:
        with self.fs.open_input_file(path) as f:
            return f.read_at(max(0, min(stop, f.size()) - start), start)


def place(files: Files, path: str, at: int) -> dict:
    """What an offset says of a file that was read up to ``at``."""
    return {"at": at, "guard": files.read(path, max(0, at - GUARD), at).hex(), "head": zlib.crc32(files.read(path, 0, min(at, GUARD)))}


def holds(files: Files, path: str, entry: dict) -> bool:
    """Whether the file still is the one of ``entry``: no shorter, and equal at its head and before its place."""
    try:
        return files.info(path).size is not None and files.info(path).size >= entry["at"] and place(files, path, entry["at"]) == {k: entry[k] for k in ("at", "guard", "head")}
    except OSError:
        return False


def whole_lines(files: Files, path: str, start: int, size: int, most: int) -> int:
    """The end of the last whole line within ``most`` bytes behind ``start``; that of the first line if it is longer; ``start`` if no line has ended."""
    stop = min(size, start + most)
    high = stop
    while high > start:
        low = max(start, high - BLOCK)
        k = files.read(path, low, high).rfind(b"\n")
        if k >= 0:
            return low + k + 1
        high = low
    while stop < size:
        block = files.read(path, stop, min(size, stop + BLOCK))
        k = block.find(b"\n")
        if k >= 0:
            return stop + k + 1
        if not block:
            break
        stop += len(block)
    return start


class Piece(InputPartition):
    def __init__(self, root: str, path: str, start: int, stop: int, guard: str, history: int):
        super().__init__((root, path, start, stop, guard, history))


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}  # Spark gives them in lower case
        get = lambda k, d: type(d)(options.get(k.lower(), d))
        self.roots = [r for r in options.get("path", "").split(",") if r]
        self.most_files, self.most_bytes = get("maxFiles", MOST_FILES), get("maxBytes", MOST_BYTES)
        self.recent, self.keep, self.forget, self.pause = get("recentSeconds", float(RECENT_SECONDS)), get("keepSeconds", float(KEEP_SECONDS)), get("forgetSeconds", float(FORGET_SECONDS)), get("discoverSeconds", float(DISCOVER_SECONDS))
        self.state = options.get("statedir")
        self.known: dict[str, dict] | None = None
        self.listed = 0.0

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _load(self) -> dict[str, dict]:
        """What was planned last, so that files of long ago are known after a restart. What is read is decided by Spark's own offsets alone: a plan that never ran does no harm."""
        if not self.state:
            return {}
        files = Files(self.state)
        path = f"{files.base}/known.json"
        info = files.info(path)
        return json.loads(files.read(path, 0, info.size)) if info.type == pafs.FileType.File else {}

    def _save(self, known: dict[str, dict]) -> None:
        if self.state:
            files = Files(self.state)
            files.fs.create_dir(files.base, recursive=True)
            with files.fs.open_output_stream(f"{files.base}/known.new") as f:
                f.write(json.dumps(known).encode())
            files.fs.move(f"{files.base}/known.new", f"{files.base}/known.json")

    def latestOffset(self) -> dict:
        now = time.time()
        if self.known is None:
            self.known = self._load()
        out, fresh = {}, []
        for root in self.roots:
            files = Files(root)
            mine = {p: e for p, e in self.known.items() if e["root"] == root}
            if now - self.listed >= self.pause:
                # a file may be under several roots: the first one has it
                fresh += [(-f.mtime.timestamp(), f.path, root) for f in files.listing() if f.size and f.path not in self.known and f.path not in {p for _, p, _ in fresh} and followed(f.path) and now - f.mtime.timestamp() <= self.recent]
            for path, entry in mine.items():
                info = files.info(path)
                if info.type != pafs.FileType.File:
                    continue  # gone: so is its entry
                written = info.mtime.timestamp()
                if now - max(written, entry["seen"]) > self.forget:
                    continue
                live = entry["live"] and now - max(written, entry["seen"]) <= self.keep
                if not live and now - written <= self.recent and written > entry["seen"]:
                    fresh.append((-written, path, root))
                out[path] = entry | {"live": live}
                if live:
                    out[path] = self._ahead(files, path, entry, info.size, now)
        if now - self.listed >= self.pause:
            self.listed = now
        room = self.most_files - sum(e["live"] for e in out.values())
        for _, path, root in sorted(fresh)[: max(0, room)]:
            files = Files(root)
            size = files.info(path).size
            new = {"root": root, "at": 0, "guard": "", "head": 0, "history": whole_lines(files, path, 0, size, size), "seen": int(now), "live": True}
            try:
                out[path] = self._ahead(files, path, self.known.get(path, new) | {"live": True}, size, now)
            except OSError:
                continue
        out = dict(sorted(out.items()))
        if out != self.known:
            self._save(out)
        self.known = out
        return {"files": out}

    def _ahead(self, files: Files, path: str, entry: dict, size: int, now: float) -> dict:
        if entry["at"] and not holds(files, path, entry):
            entry = entry | {"at": 0, "history": 0}  # another file by this name: nothing of it is history
        at = whole_lines(files, path, entry["at"], size, self.most_bytes)
        moved = at != self.known.get(path, {}).get("at")
        return entry | place(files, path, at) | {"live": True, "seen": int(now) if moved else entry["seen"]}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, e in end["files"].items():
            s = start["files"].get(path)
            if s == e:
                continue
            low = s["at"] if s and s["at"] <= e["at"] and (s["at"] == 0 or holds(Files(e["root"]), path, s)) else 0
            if low < e["at"]:
                out.append(Piece(e["root"], path, low, e["at"], e["guard"], e["history"]))
        # what this reader doesn't know since it began after a restart stays known
        self.known = {**{p: e for p, e in start["files"].items() if p not in end["files"]}, **(self.known or {})} if self.known is not None else self.known
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        root, path, start, stop, guard, history = partition.value
        try:
            data = Files(root).read(path, start, stop)
        except OSError:
            return
        if len(data) != stop - start or data[-GUARD:].hex()[-len(guard) :] != guard[-2 * min(GUARD, len(data)) :]:
            return  # cut or replaced since the batch was planned; the next one reads what is there now
        offsets, lines, at = [], [], 0
        while at < len(data):
            end = data.index(b"\n", at)
            line = data[at:end].rstrip(b"\r")
            if line.strip():
                offsets.append(start + at)
                lines.append(line.decode("utf-8", "replace"))
            at = end + 1
        past = [o < history for o in offsets]
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(offsets, pa.int64()), pa.array(lines, pa.string()), pa.array(past, pa.bool_())], ["path", "offset", "raw", "history"])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail_lines(spark: SparkSession, roots: list[str], state_dir: str | None = None, **options) -> DataFrame:
    """``(path, offset, raw, history)``: the whole, non-blank lines of the JSONL files below ``roots``, as they are appended.

    Followed are files written in the last 15 minutes that aren't empty (the newest first, 96 at once) and those that grew in the last 30. Each line comes once, also over restarts: after a cut or a
    replacement of a file all lines of the new content come. ``history`` marks lines that were there when the file was first seen. A file that wasn't written for a week is
    forgotten. ``state_dir``, in shared storage, keeps the files that aren't followed just now known over a restart. Options: maxFiles, maxBytes, recentSeconds, keepSeconds, forgetSeconds, discoverSeconds.
    """
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("jsonl_tail").options(path=",".join(roots), **{k: str(v) for k, v in options.items()})
    return (reader.option("stateDir", state_dir) if state_dir else reader).load()

"""Raw rows in partitions of file bucket and day, derived rows beside them, and one snapshot that says what of it counts.

Every write makes new partition folders, ``<table>/version=<v>/bucket=<b>/day=<d>``, and then a snapshot, ``_ledger/<n>.json``, that names the live version of each partition: readers see all of
a write or nothing, and of two writers that began from one snapshot the later one fails. So replacing a file's rows rewrites the partitions in which it has any, a file is read
from its bucket alone, old days are dropped by leaving them out of the snapshot, and what no snapshot names is deleted by ``vacuum``. A snapshot holds one entry a partition.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import incremental
from tallyloom.schemas import FREEZE_DAYS

BUCKETS = 64
DAY_MS = 86_400_000
MOST_FILES = 10_000
Upcast = Callable[[DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer was first."""


class Migrations:
    """Up-casts of tables from one schema version to the next; reading applies all from a partition's version on."""

    def __init__(self, newest: int = 1):
        self.newest, self.steps = newest, {}

    def step(self, table: str, version: int) -> Callable[[Upcast], Upcast]:
        """Registers what makes rows of ``version`` rows of the next one."""

        def add(f: Upcast) -> Upcast:
            if (table, version) in self.steps:
                raise ValueError(f"{table} has two steps from version {version}")
            self.steps[table, version] = f
            self.newest = max(self.newest, version + 1)
            return f

        return add

    def upcast(self, rows: DataFrame, table: str, version: int) -> DataFrame:
        if version > self.newest:
            raise ValueError(f"{table} has rows of schema {version}; this code knows {self.newest}")
        for v in range(version, self.newest):
            rows = self.steps[table, v](rows) if (table, v) in self.steps else rows
        return rows


class Ledger:
    """A ledger below ``path``. Tables' rows have file_id and ts_ms; the row of a file in ``files`` says which days it has."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, migrations: Migrations | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.migrations = migrations or Migrations()
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- snapshots -------------------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.path}/_ledger/*.json")) or []
        return sorted(int(s.getPath().getName()[:-5]) for s in found)

    def snapshot(self) -> dict:
        """The newest whole snapshot; one that broke off while it was written doesn't count."""
        for n in reversed(self._numbers()):
            stream = self._fs.open(self._path(f"{self.path}/_ledger/{n}.json"))
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            if text.endswith("\n"):
                return json.loads(text) | {"n": n}
        return {"n": 0, "tables": {}, "derived": None, "revision": 0, "pending": False, "frozen_ms": 0, "claimed": None, "done": [], "outbox": None}

    def commit(self, old: dict, **changes) -> dict:
        """The snapshot after ``old`` with ``changes``; fails if there is one already."""
        new = old | changes
        n = max([old["n"], *self._numbers()]) + 1
        if self.snapshot()["n"] != old["n"]:
            raise Conflict("the ledger was written to in the meantime")
        name = self._path(f"{self.path}/_ledger/{n}.json")
        try:
            stream = self._fs.create(name, False)
        except Exception as e:
            raise Conflict("the ledger is being written to") from e
        stream.write(bytearray((json.dumps({k: v for k, v in new.items() if k != "n"}) + "\n").encode()))
        stream.close()
        return new | {"n": n}

    # -- raw rows --------------------------------------------------------------------------------

    def _bucket(self, column: str = "file_id"):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _placed(self, rows: DataFrame) -> DataFrame:
        day = F.date_format(F.timestamp_millis(F.floor(F.col("ts_ms") / DAY_MS) * DAY_MS), "yyyy-MM-dd")
        return rows.withColumns({"bucket": self._bucket(), "day": day})

    def _write(self, rows: DataFrame, table: str, wanted: set[str]) -> dict[str, dict]:
        """Writes a new version of the ``wanted`` partitions (``bucket/day``) and returns the entries of those that have rows."""
        version = uuid.uuid4().hex
        base = f"{self.path}/{table}/version={version}"
        self._placed(rows).repartition("bucket", "day").write.partitionBy("bucket", "day").parquet(base)
        made = {f"{p.getParent().getName()[7:]}/{p.getName()[4:]}" for p in (s.getPath() for s in self._fs.globStatus(self._path(f"{base}/bucket=*/day=*")) or [])}
        if made - wanted:
            raise ValueError(f"rows outside of the partitions that are written: {sorted(made - wanted)[:3]}")
        return {p: {"version": version, "schema": self.migrations.newest} for p in made}

    def read(self, table: str, file_ids: list[str] | None = None, days: tuple[str, str] | None = None, at: dict | None = None) -> DataFrame:
        """Live rows of the table, of some files or of the days from one to another; only the partitions concerned are listed and read."""
        snap = at or self.snapshot()
        parts = snap["tables"].get(table, {})
        if file_ids is not None:
            hashed = self.spark.createDataFrame([(f,) for f in file_ids], "file_id string").select(self._bucket()).distinct().collect()
            parts = {p: e for p, e in parts.items() if int(p.split("/")[0]) in {r[0] for r in hashed}}
        if days is not None:
            parts = {p: e for p, e in parts.items() if days[0] <= p.split("/")[1] <= days[1]}
        rows = self._partitions(table, parts)
        rows = rows if file_ids is None else rows.where(F.col("file_id").isin(file_ids))
        if snap["claimed"] is not None and "hostname" in rows.columns:
            rows = rows.withColumn("hostname", F.when(F.col("hostname") == "", snap["claimed"]).otherwise(F.col("hostname")))
        return rows

    def _partitions(self, table: str, parts: dict[str, dict]) -> DataFrame:
        groups: dict[int, list[str]] = {}
        for p, e in sorted(parts.items()):
            bucket, day = p.split("/")
            groups.setdefault(e["schema"], []).append(f"{self.path}/{table}/version={e['version']}/bucket={bucket}/day={day}")
        if not groups:
            known = self._fs.globStatus(self._path(f"{self.path}/{table}/version=*")) or []
            if not known:
                raise ValueError(f"there is no table {table!r}")
            return self.migrations.upcast(self.spark.read.parquet(known[0].getPath().toString()).drop("bucket", "day"), table, self.migrations.newest).limit(0)
        return reduce(lambda a, b: a.unionByName(b), (self.migrations.upcast(self.spark.read.option("mergeSchema", "true").parquet(*paths), table, v) for v, paths in sorted(groups.items())))

    def record(self, files: DataFrame, **tables: DataFrame) -> dict:
        """Replaces all rows of ``files`` (file_id, source, offset, size, status and more) in one step. Rows of other files and rows before the freeze line are left out.

        At most ``MOST_FILES`` files a call: their names, and the days they have, pass through the driver.
        """
        snap = self.snapshot()
        names = [r["file_id"] for r in files.select("file_id").limit(MOST_FILES + 1).collect()]
        if len(names) > MOST_FILES:
            raise ValueError(f"more than {MOST_FILES} files at once")
        if files.where("offset > size").limit(1).count():
            raise ValueError("a checkpoint lies behind the end of its file")
        only = F.broadcast(files.select("file_id"))
        live = {t: dict(parts) for t, parts in snap["tables"].items()}
        for table, rows in {**tables, "files": files.withColumn("ts_ms", F.lit(0).cast("long"))}.items():
            new = rows.join(only, "file_id", "left_semi")
            if table != "files":
                new = new.where(F.col("ts_ms") >= snap["frozen_ms"])
            hit = {f"{r['bucket']}/{r['day']}" for r in self._placed(new).select("bucket", "day").distinct().collect()}
            if parts := live.get(table):
                mine = {int(r[0]) for r in self.spark.createDataFrame([(f,) for f in names], "file_id string").select(self._bucket()).distinct().collect()}
                near = self._partitions(table, {p: e for p, e in parts.items() if int(p.split("/")[0]) in mine})
                hit |= {f"{r['bucket']}/{r['day']}" for r in self._placed(near.select("file_id", "ts_ms")).join(only, "file_id", "left_semi").select("bucket", "day").distinct().collect()}
                old = {p: e for p, e in parts.items() if p in hit}
                if old:
                    new = self._partitions(table, old).join(only, "file_id", "left_anti").unionByName(new, allowMissingColumns=True)
            written = self._write(new, table, hit) if hit else {}
            live[table] = {p: e for p, e in live.get(table, {}).items() if p not in hit} | written
        return self.commit(snap, tables=live, pending=True, done=[])

    def files(self) -> DataFrame:
        return self.read("files").drop("ts_ms")

    # -- maintenance -----------------------------------------------------------------------------

    def drop_before(self, snap: dict, frozen_ms: int, events: str = "events", session_events: str = "session_events") -> dict[str, dict]:
        """The snapshot's tables without what lies before the freeze: whole days are left out, only the day of the line is rewritten; sessions with a row past the line stay whole."""
        live = {t: dict(parts) for t, parts in snap["tables"].items()}
        line = datetime.datetime.fromtimestamp(frozen_ms / 1000, datetime.UTC).strftime("%Y-%m-%d")
        split = lambda parts: ({p: e for p, e in parts.items() if p.split("/")[1] < line}, {p: e for p, e in parts.items() if p.split("/")[1] == line})
        if events in live:
            before, at = split(live[events])
            kept = self._write(self._partitions(events, at).where(F.col("ts_ms") >= frozen_ms), events, set(at)) if at else {}
            live[events] = {p: e for p, e in live[events].items() if p not in before and p not in at} | kept
        if session_events in live:
            before, at = split(live[session_events])
            if old := before | at:
                alive = self._partitions(session_events, {p: e for p, e in live[session_events].items() if p not in before}).where(F.col("ts_ms") >= frozen_ms).select("source", "session_hash").distinct()
                kept = self._write(self._partitions(session_events, old).join(alive, ["source", "session_hash"], "left_semi"), session_events, set(old))
                live[session_events] = {p: e for p, e in live[session_events].items() if p not in old} | kept
        return live

    def vacuum(self) -> int:
        """Deletes versions and snapshots that the newest snapshot doesn't need, and says how many versions went. Nobody else may be writing or reading older snapshots meanwhile."""
        snap, gone = self.snapshot(), 0
        live = {(t, e["version"]) for t, parts in snap["tables"].items() for e in parts.values()} | {("derived", snap["derived"]), ("outbox", (snap["outbox"] or {}).get("version"))}
        for s in self._fs.globStatus(self._path(f"{self.path}/*/version=*")) or []:
            p = s.getPath()
            if (p.getParent().getName(), p.getName()[8:]) not in live:
                self._fs.delete(p, True)
                gone += 1
        for n in self._numbers():
            if n < snap["n"]:
                self._fs.delete(self._path(f"{self.path}/_ledger/{n}.json"), False)
        return gone

    # -- derived rows ----------------------------------------------------------------------------

    def write_version(self, rows: DataFrame, table: str) -> str:
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{table}/version={version}")
        return version

    def read_version(self, table: str, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}/version={version}")

    def derived(self, at: dict | None = None) -> DataFrame:
        """The derived rows, refused while raw rows wait or a finalize hasn't ended."""
        snap = at or self.snapshot()
        if snap["pending"] or snap["done"] or snap["derived"] is None:
            raise ValueError("raw rows wait to be derived")
        return self.read_version("derived", snap["derived"])


def finalize(ledger: Ledger, derive: Callable[[DataFrame], DataFrame], keys: list[str], values: list[str], hostname: str, now_ms: int, compact: bool = False, after: Callable[[str], None] = lambda step: None) -> dict:
    """Claims unnamed rows, recomputes the derived rows, clears the pending mark and, if asked to, moves the freeze line and drops what lies before it.

    ``derive`` makes the derived rows (``keys``, ``values``, one of the keys bucket_start_ms) of the raw events. Each step ends with a snapshot that names it as done; a call after a crash skips the
    steps that are done and repeats the one that broke off, whose unnamed files ``vacuum`` deletes. Rows recorded meanwhile start it over. ``after`` is called behind each step.
    """
    snap = ledger.snapshot()

    def step(name: str, act: Callable[[dict], dict]) -> None:
        nonlocal snap
        if name not in snap["done"]:
            snap = ledger.commit(snap, **act(snap), done=[*snap["done"], name])
        after(name)

    def claim(s: dict) -> dict:
        if s["claimed"] is not None or "hostname" not in ledger.read("events", at=s).columns:
            return {}
        hosts = ledger.read("events", at=s).where(~F.col("hostname").isin("", hostname)).limit(1).count()
        return {} if hosts else {"claimed": hostname}

    def recompute(s: dict) -> dict:
        new = derive(ledger.read("events", at=s)).select(*keys, *values)
        if s["derived"] is None:
            out, changed, revision = new.withColumns({"revision": F.lit(1).cast("long"), "synced_revision": F.lit(0).cast("long")}), True, s["revision"]
        else:
            revision = s["revision"]
            out, changes = incremental.recompute(ledger.read_version("derived", s["derived"]), new, keys, values, revision, s["frozen_ms"])
            changed = bool(changes.where("change <> 'unchanged'").limit(1).count())
        return {"derived": ledger.write_version(out, "derived"), "revision": revision + 1, "outbox": None} if changed else {}

    def freeze(s: dict) -> dict:
        return {"frozen_ms": incremental.advance_frozen(s["frozen_ms"], now_ms, ledger.files(), s["pending"], FREEZE_DAYS)}

    def drop(s: dict) -> dict:
        return {"tables": ledger.drop_before(s, s["frozen_ms"])} if s["frozen_ms"] else {}

    step("claim", claim)
    step("recompute", recompute)
    step("clear", lambda s: {"pending": False})
    if compact:
        step("freeze", freeze)
        step("compact", drop)
    snap = ledger.commit(snap, done=[])
    return snap


# -- reporting -----------------------------------------------------------------------------------


def _outbox(ledger: Ledger, snap: dict, order: list[str], most: int) -> dict:
    """Open rows in pages of ``most``, sorted once by (revision, ``order``) and laid out by page, so a page's range of files and row groups is found by their statistics."""
    rows = ledger.derived(snap).where(F.col("revision") > F.col("synced_revision"))
    n = incremental.numbered(rows, ["revision", *order]).withColumnRenamed("row_no", "__n")
    paged = rows.join(n, ["revision", *order]).withColumn("page", F.floor(F.col("__n") / most).cast("long")).drop("__n")
    version = ledger.write_version(paged.repartitionByRange("page").sortWithinPartitions("page", "revision", *order), "outbox")
    return {"version": version, "pages": (ledger.read_version("outbox", version).agg(F.max("page")).first()[0] or 0) + 1 if rows.limit(1).count() else 0, "acked": 0, "most": most}


def report(ledger: Ledger, send: Callable[[list[dict]], int], order: list[str], hostname: str, most: int = 500, chunk: int = 40) -> dict:
    """Sends the open derived rows of ``hostname`` page by page and acknowledges what was confirmed exactly: ``{attempted, acknowledged, pending, failed}``.

    ``send`` takes a page's rows and says how many were accepted; another number than the page's, or an exception, stops the loop, and nothing of that page or behind it is
    acknowledged. Each confirmed page is noted in a snapshot, so a call after a crash goes on behind it; the rows are marked as synced in one pass at the end. At most
    ``chunk`` pages are in the driver at a time.
    """
    snap = ledger.snapshot()
    if snap["claimed"] not in (None, hostname):
        raise ValueError("the ledger belongs to another host: a rebuild is needed")
    if snap["outbox"] is None:
        snap = ledger.commit(snap, outbox=_outbox(ledger, snap, order, min(max(most, 1), 2000)))
    box, attempted, failed = snap["outbox"], 0, None
    rows = ledger.read_version("outbox", box["version"])
    while box["acked"] < box["pages"] and failed is None:
        low = box["acked"]
        got = rows.where((F.col("page") >= low) & (F.col("page") < low + chunk)).collect()
        for page in range(low, min(low + chunk, box["pages"])):
            own = sorted((r for r in got if r["page"] == page), key=lambda r: (r["revision"], *(r[c] for c in order)))
            attempted += len(own)
            try:
                accepted = send([{k: v for k, v in r.asDict().items() if k not in ("page", "synced_revision")} for r in own])
            except Exception as e:  # noqa: BLE001  whatever the receiver raises ends the loop
                failed = str(e)
                break
            if accepted != len(own):
                failed = f"{accepted} of {len(own)} rows were confirmed"
                break
            box = box | {"acked": page + 1}
            snap = ledger.commit(snap, outbox=box)
    sent = rows.where(F.col("page") < box["acked"])
    done = sent.count()
    if done:
        keys = [c for c in order]
        synced = incremental.acknowledge(ledger.derived(snap), sent, keys)
        snap = ledger.commit(snap, derived=ledger.write_version(synced, "derived"), outbox=None)
    open_ = ledger.derived(snap).where(F.col("revision") > F.col("synced_revision")).count()
    return {"attempted": attempted, "acknowledged": done, "pending": open_, "failed": failed}

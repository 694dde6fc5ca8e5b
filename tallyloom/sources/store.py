"""Raw rows on plain Parquet, replaced file by file.

Every write is a new generation; a manifest names the live generation of each file. Readers keep the rows of live generations, so
replacing all rows of a file takes effect at once, when the manifest's generation is complete, and a failed write shows nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.dedup import merge_upserts

SCHEMA_VERSION = 1
MANIFEST = "file_id string, source string, offset long, size long, mtime_ms long, parser_version int, status string, generation long"


class RawStore:
    """Generations below ``path``: ``<table>/generation=<n>`` and ``manifest/generation=<n>``; ``derived/generation=<n>`` marks what is derived."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        newest = max(self._generations("schema"), default=SCHEMA_VERSION)
        if newest > SCHEMA_VERSION:
            raise ValueError(f"the store has schema {newest}; this code knows {SCHEMA_VERSION}")
        self._mark("schema", SCHEMA_VERSION)

    def _generations(self, table: str) -> list[int]:
        """Complete generations: those whose write left its mark."""
        found = self._fs.globStatus(self._fs_path(f"{self.path}/{table}/generation=*/_SUCCESS")) or []
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)

    def _mark(self, table: str, generation: int) -> None:
        self._fs.create(self._fs_path(f"{self.path}/{table}/generation={generation}/_SUCCESS"), True).close()

    def next_generation(self) -> int:
        return max(self._generations("manifest"), default=0) + 1

    def record(self, files: DataFrame, **tables: DataFrame) -> int:
        """Replaces all rows of the given files. The tables are written first and the manifest last; it makes them visible."""
        bad = files.where("offset > size").limit(1).count()
        if bad:
            raise ValueError("a checkpoint lies behind the end of its file")
        g = self.next_generation()
        for name, rows in tables.items():
            rows.join(files.select("file_id"), "file_id", "left_semi").write.mode("overwrite").parquet(f"{self.path}/{name}/generation={g}")
        files.withColumn("generation", F.lit(g).cast("long")).write.mode("overwrite").parquet(f"{self.path}/manifest/generation={g}")
        return g

    def record_network(self, source: str, events: DataFrame) -> int | None:
        """Adds rows without a file of their own; they merge by event id when read. Nothing happens without rows."""
        if events.isEmpty():
            return None
        g, file_id = self.next_generation(), f"network\x01{source}"
        rows = events.withColumns({"file_id": F.lit(file_id), "seq": F.lit(g).cast("long")})
        rows.write.mode("overwrite").parquet(f"{self.path}/network_events/generation={g}")
        one = self.spark.createDataFrame([(file_id, source, 0, 0, 0, 0, "complete", g)], MANIFEST)
        one.write.mode("overwrite").parquet(f"{self.path}/manifest/generation={g}")
        return g

    def manifest(self) -> DataFrame:
        """The latest checkpoint of each file."""
        done = self._generations("manifest")
        if not done:
            return self.spark.createDataFrame([], MANIFEST)
        rows = self._union("manifest", done, MANIFEST)
        rest = [c for c in rows.columns if c != "file_id"]
        return rows.groupBy("file_id").agg(F.max_by(F.struct(*rest), "generation").alias("m")).select("file_id", "m.*")

    def _union(self, table: str, generations: list[int], schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read.option("mergeSchema", "true")
        return reader.parquet(*[f"{self.path}/{table}/generation={g}" for g in generations])

    def read(self, table: str) -> DataFrame:
        """Live rows: of each file those of its live generation."""
        done = set(self._generations("manifest")) & set(self._generations(table))
        if not done:
            raise ValueError(f"there is no table {table!r}")
        live = self.manifest().select("file_id", "generation")
        rows = self._union(table, sorted(done)).withColumn("generation", F.regexp_extract(F.col("_metadata.file_path"), r"generation=(\d+)", 1).cast("long"))
        return rows.join(live, ["file_id", "generation"], "left_semi").drop("generation")

    def read_network(self) -> DataFrame:
        return merge_upserts(self._union("network_events", self._generations("network_events")))

    def pending_derivation(self) -> bool:
        """Whether raw rows were written after what was derived last."""
        return max(self._generations("manifest"), default=0) > max(self._generations("derived"), default=0)

    def write_derived(self, **tables: DataFrame) -> int:
        """Derived tables of the current raw generation; the mark comes last and clears the pending state."""
        g = max(self._generations("manifest"), default=0)
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/generation={g}")
        self._mark("derived", g)
        return g

    def read_derived(self, table: str) -> DataFrame:
        """The table as derived last; refused while raw rows wait."""
        if self.pending_derivation():
            raise ValueError("raw rows wait to be derived")
        return self._union(table, [max(self._generations("derived"))])

"""Small helpers that the corpus operators share: shared storage, tables and hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names no such folder and runs in one process (local tests) one is made in the machine's temp folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/corpus-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in shared storage."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_shared(spark: SparkSession) -> None:
    """Deletes what this application has stored between steps. Call it once all results are written: lazy results read from there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends here, and a
    lost executor costs no recomputation of what lies before."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_split(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, most: int = 10_000) -> DataFrame:
    """Inner join of ``left`` with ``right``, unique by ``key``, whose column ``rows`` counts the rows of ``left`` that have it (``total`` in all).

    Keys that hold more than one in ``most`` of all rows are fewer than ``most``, so they are broadcast and their rows stay where they are;
    all other keys are joined by a shuffle.
    """
    often = F.col(rows) > total / most
    hot = F.broadcast(right.where(often))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(~often).hint("merge"), key)
    return left.join(hot, key).unionByName(rest)


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids belong to fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % parts, F.lit(0)).cast("int")

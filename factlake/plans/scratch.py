"""Scratch tables in the shared checkpoint folder.

Iterative operators cut lineage by writing a round to a Parquet table and reading it back.  Compared
with an RDD checkpoint this keeps the data columnar and gives Catalyst the true size of every
intermediate, so a small delta is broadcast and a large one is shuffled without any hint.  The files
sit on shared storage and survive the loss of executors.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

_local_roots: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go when it ends: the table is what is read, and else they stay until the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def scratch_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="factlake-")
    return _local_roots[app]


@dataclass(frozen=True)
class Table:
    df: DataFrame
    path: str
    rows: int


class Scratch:
    """Tables of one operator call, below ``<scratch root>/factlake/<name>-<uuid>``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/factlake/{name}-{uuid.uuid4().hex[:12]}"
        self._next = 0

    def path(self, label: str = "t") -> str:
        self._next += 1
        return f"{self.base}/{label}{self._next}"

    def _write(self, df: DataFrame, label: str) -> str:
        path = self.path(label)
        with _no_shuffle_left(self.spark):
            df.write.parquet(path)
        return path

    def save(self, df: DataFrame, label: str = "t") -> Table:
        path = self._write(df, label)
        back = self.spark.read.schema(df.schema).parquet(path)
        # counted from the Parquet footers: no column is read
        return Table(back, path, back.count())

    def put(self, df: DataFrame, label: str = "t") -> Table:
        """As ``save``, but the rows are not counted (-1)."""
        path = self._write(df, label)
        return Table(self.spark.read.schema(df.schema).parquet(path), path, -1)

    def some(self, df: DataFrame, n: int = 3) -> list[Row]:
        """Up to ``n`` rows, brought by way of a table so that no shuffle files are left."""
        return self.put(df.limit(n), "x").df.collect()

    def read(self, paths: list[str], like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*paths)

    def drop(self, path: str) -> None:
        """Delete a superseded table; nothing still reads it."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

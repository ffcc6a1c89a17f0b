"""Cutting lineage with tables in the shared checkpoint folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a default only where none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or "/tmp/checkpoints")
    return spark.sparkContext.getCheckpointDir()


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system as Hadoop's objects."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


class Journal:
    """What an iteration has completed, so that a new driver can go on from there.

    Its folder bears the run's name, in the shared checkpoint folder. An entry is written beside and renamed,
    so it is there as a whole or not at all, and replaces the one before it.
    """

    def __init__(self, spark: SparkSession, run: str):
        self.spark, self.base, self.last = spark, f"{checkpoint_dir(spark)}/run-{run}", 0

    def load(self) -> dict | None:
        """The last entry."""
        folder, fs = _hadoop(self.spark, self.base)
        if not fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        found = sorted(int(n[len("entry-") :]) for n in names if n.startswith("entry-"))
        if not found:
            return None
        self.last = found[-1]
        return json.loads(self.spark.read.text(f"{self.base}/entry-{self.last}", wholetext=True).first()[0])

    def commit(self, entry: dict) -> None:
        beside, fs = _hadoop(self.spark, f"{self.base}/.entry")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        self.last += 1
        if not fs.rename(beside, _hadoop(self.spark, f"{self.base}/entry-{self.last}")[0]):
            raise OSError(f"entry {self.last} of {self.base} can't be committed")
        fs.delete(_hadoop(self.spark, f"{self.base}/entry-{self.last - 1}")[0], True)

    def finish(self, *keep: DataFrame) -> None:
        """Delete all but the tables ``keep``."""
        folder, fs = _hadoop(self.spark, self.base)
        kept = {df._scratch_path.rsplit("/", 1)[-1] for df in keep}
        for s in fs.listStatus(folder):
            if s.getPath().getName() not in kept:
                fs.delete(s.getPath(), True)


class Scratch:
    """Tables written to the shared checkpoint folder, which survive the loss of an executor."""

    def __init__(self, spark: SparkSession, name: str, base: str | None = None):
        """In a folder of its own, or in ``base``, where tables of an attempt that broke off are written anew."""
        self.spark, self.base, self.n = spark, base or f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def _next(self) -> str:
        self.n += 1
        return f"{self.base}/{self.n}"

    def cut(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """``df`` from a table; with ``partition_by`` in a directory for each value of that column, so that filters on it skip the others."""
        path = self._next()
        if partition_by is None:
            df.write.mode("overwrite").parquet(path)
        else:
            # a rebalance by the column, so that a directory with very many rows is written by several tasks
            df.hint("rebalance", partition_by).write.mode("overwrite").partitionBy(partition_by).parquet(path)
        return self.read(path, df.schema)

    def read(self, path: str, schema: StructType | None = None) -> DataFrame:
        """A table that ``cut`` has written."""
        out = (self.spark.read if schema is None else self.spark.read.schema(schema)).parquet(path)
        out._scratch_path = path
        return out

    def cut_counting(self, df: DataFrame, keep: Sequence[str] | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
        """``cut`` of the columns ``keep`` (all of them), and aggregates of the rows, taken by the write itself: no second job."""
        seen = Observation()
        observed = df.observe(seen, *[c.alias(name) for name, c in metrics.items()])
        return self.cut(observed if keep is None else observed.select(*keep)), seen.get

    def drop(self, df: DataFrame) -> None:
        """Delete a table of ``cut`` that nothing reads any more."""
        path, fs = _hadoop(self.spark, df._scratch_path)
        fs.delete(path, True)


def dealt(df: DataFrame, *columns: str, parts: int | None = None) -> DataFrame:
    """``df`` persisted, dealt by ``columns`` into the usual number of partitions or ``parts``, so that joins and sums by them need no shuffle.

    Lost partitions are computed again from what ``df`` reads. The cached plan itself isn't
    adaptive: later plans could not rely on its partitioning otherwise.
    """
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        return df.repartition(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *columns).persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)

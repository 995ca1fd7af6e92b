"""Resumable work: what is done is skipped, new rows are merged, and micro-batches upsert into a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quakeframe.operators.windows import upsert


def pending(tasks: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Tasks that are not in the list of done ones."""
    return tasks.join(done.select(*key).distinct(), list(key), "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class UpsertTable:
    """A table in versions: each merge writes a new folder, and readers take the last complete one; the last two stay.

    A merge that dies leaves the version before as it was; a batch that is run again is merged into the same version,
    so that every batch counts once.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str], schema: str):
        self.spark, self.path, self.key, self.order, self.schema = spark, path.rstrip("/"), list(key), list(order), schema

    def version(self, below: int | None = None) -> int:
        """Number of the last complete version (under ``below``), -1 without any."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(root):
            return -1
        names = [s.getPath().getName() for s in system.listStatus(root)]
        found = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and _exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        return max([v for v in found if below is None or v < below], default=-1)

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}") if v >= 0 else self.spark.createDataFrame([], self.schema)

    def merge(self, rows: DataFrame, version: int | None = None) -> int:
        """Write the version after the last (or that of a batch) with ``rows`` merged in: the newest row of a key stays."""
        v = self.version() + 1 if version is None else version
        before = self.read(self.version(below=v))
        upsert(before, rows, self.key, self.order).write.mode("overwrite").parquet(f"{self.path}/v{v}")
        old = self.version(below=self.version(below=v))  # readers may still be at the version before
        if old >= 0:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return v

    def follow(self, stream: DataFrame, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
        """Merge each micro-batch of a stream as the version of its number, until the input at hand is used up."""
        def batch(rows: DataFrame, number: int) -> None:
            self.merge(prepare(rows), number)

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum by time window and key, late rows up to a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")

"""Intermediate tables in the folder that every executor shares.

A kept table is a Parquet directory below ``spark.checkpoint.dir``: it cuts the
lineage, survives lost executors and has sizes that the optimizer can see.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a local one, in local mode alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="pagegrain-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def delete(spark: SparkSession, uri: str) -> None:
    """Remove a directory through Hadoop's file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows, for the jobs that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of an Arrow batch while a table is kept; the JVM's and the worker's copies of a batch of texts lie outside the heap.
ARROW_ROWS = 1000


class Scratch:
    """Tables of one operator run. ``keep`` writes one, ``drop`` removes one early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        atexit.register(self._close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        schema = df.schema
        with arrow_rows(self.spark, ARROW_ROWS):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def keep_bucketed(self, name: str, df: DataFrame, column: str) -> DataFrame:
        """A kept table in buckets of a column, as many as shuffle partitions: joins on it leave its rows in place."""
        table = f"pagegrain_{os.path.basename(self.root).replace('-', '_')}_{name}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with arrow_rows(self.spark, ARROW_ROWS):
            df.write.mode("overwrite").format("parquet").bucketBy(buckets, column).option("path", self.path(name)).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))

    def release(self) -> None:
        """Let Spark's cleaner remove shuffle files that no live plan refers to."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _close(self) -> None:
        try:
            for table in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            delete(self.spark, self.root)
        except Exception:  # the JVM is gone at interpreter exit
            pass

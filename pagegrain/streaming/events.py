"""Streams of job events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the events table's files; ``path`` is a folder or a pattern."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def status_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by status in tumbling windows; what is later than the watermark is dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("event_type").alias("status"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: runs of events with no longer gap."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))


def change_stream(events: DataFrame, terminal: Sequence[str]) -> DataFrame:
    """job, event_id, status and progress of each event that changes one of the two, up to the first terminal one.

    A job's state is what was last given out and whether it has ended; its events are
    taken in order of time within a batch and of batches. Null and equal values are no
    change.
    """
    ends = frozenset(terminal)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ended = (state.get[:2], state.get[2]) if state.exists else (None, False)
        rows = [] if ended else sorted((r for b in batches for r in b[["ts", "event_id", "status", "progress"]].itertuples(index=False)), key=lambda r: r[:2])
        out = []
        for row in rows:
            now = (row.status, None if pd.isna(row.progress) else int(row.progress))
            if now != last:
                out.append((*key, row.event_id, *now))
            last, ended = now, row.status in ends
            if ended:
                break
        if last is not None:
            state.update((*last, ended))
        yield pd.DataFrame(out, columns=["job", "event_id", "status", "progress"]).astype({"progress": "Int64"})

    rows = events.select(F.col("user_id").alias("job"), "ts", "event_id", F.col("event_type").alias("status"), F.least(F.lit(100), F.floor(F.col("value") / 5)).cast("long").alias("progress"))
    return rows.groupBy("job").applyInPandasWithState(step, "job long, event_id long, status string, progress long", "status string, progress long, ended boolean", "append", GroupStateTimeout.NoTimeout)

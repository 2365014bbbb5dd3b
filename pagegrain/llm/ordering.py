"""Global positions without a single-task sort: range partitions and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def offsets(parts: DataFrame, part: str, amount: str) -> DataFrame:
    """part and ``before``, the amounts of all lower parts. One row for each partition of a job comes in."""
    lower = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(part).agg(F.sum(amount).alias("_amount"))
    return sums.select(part, F.coalesce(F.sum("_amount").over(lower), F.lit(0)).alias("before"))


def ranked(scratch: Scratch, rows: DataFrame, *order: Column | str) -> DataFrame:
    """The rows with ``rank``, their place from 0 in this order; ties in any order, kept in a table."""
    placed = rows.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).sortWithinPartitions(*order)
    kept = scratch.keep("ranked", placed.withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = scratch.keep("ranks", offsets(kept.select(part.alias("_part"), F.lit(1).alias("_one")), "_part", "_one"))
    return kept.withColumn("_part", part).join(before, "_part").withColumn("rank", F.col("before") + within).drop("_at", "_part", "before")

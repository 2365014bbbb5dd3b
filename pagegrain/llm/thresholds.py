"""Budget thresholds over hashed keys by nested histograms, without sorting rows.

Each level sums the weights of 4096 buckets in every group, finds the bucket in
which the running sum passes the group's budget and refines that bucket alone.
A level's running sums cover 4096 rows of a group at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

STEP = 12


def budget_thresholds(scratch: Scratch, rows: DataFrame, budgets: DataFrame, bits: int = 48, nearest: bool = False) -> DataFrame:
    """For each group the largest ``threshold`` so that the rows with ``key < threshold`` weigh ``budget`` at most.

    ``rows`` has group, key (0 to 2**bits - 1) and weight, ``budgets`` group and
    budget; groups are not null. With nearest, the rows of the boundary key come in
    as well if that is closer to the budget. ``bits`` is a multiple of 12.
    """
    state = budgets.select("group", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), F.lit(False).alias("all_in"))
    for level in range(bits // STEP):
        left = bits - STEP * level
        inside = rows.join(state.where(~F.col("all_in")), "group")
        if level:
            inside = inside.where(F.shiftright("key", left) == F.col("prefix"))
        bucket = F.shiftright("key", left - STEP)
        sums = inside.groupBy("group", bucket.alias("bucket")).agg(F.sum("weight").alias("weight"))
        running = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = sums.withColumn("upto", F.sum("weight").over(running))
        # the first bucket that passes the budget is refined; without one, every row is in
        over = upto.join(state.select("group", "budget", "before"), "group").where(F.col("before") + F.col("upto") > F.col("budget"))
        edge = over.groupBy("group").agg(F.min("bucket").alias("edge"), F.min_by(F.col("upto") - F.col("weight"), "bucket").alias("less"), F.min_by("weight", "bucket").alias("edge_weight"))
        state = scratch.keep(
            f"threshold{level}",
            state.join(edge, "group", "left").select(
                "group",
                "budget",
                F.coalesce("edge", "prefix").alias("prefix"),
                (F.col("before") + F.coalesce("less", F.lit(0))).alias("before"),
                (F.col("all_in") | F.col("edge").isNull()).alias("all_in"),
                F.coalesce("edge_weight", F.lit(0)).cast("long").alias("own"),
            ),
        )
    edge_in = (F.col("before") + F.col("own") - F.col("budget")) < (F.col("budget") - F.col("before")) if nearest else F.lit(False)
    return state.select("group", F.when(F.col("all_in"), F.lit(1 << bits)).otherwise(F.col("prefix") + edge_in.cast("long")).alias("threshold"))

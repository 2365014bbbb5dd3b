"""Operators on job events, in order of time and event_id within a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def in_time() -> WindowSpec:
    return Window.partitionBy("job").orderBy("ts", "event_id")


def changes(events: DataFrame, *columns: str) -> DataFrame:
    """Events that differ from the one before in one of the columns; the first of a job always."""
    same = F.lag("event_id").over(in_time()).isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(in_time()))
    return events.withColumn("_same", same).where(~F.col("_same")).drop("_same")


def numbered(events: DataFrame, last: int) -> DataFrame:
    """``seq`` from 1, and only the last so many of each job."""
    back = Window.partitionBy("job").orderBy(F.desc("ts"), F.desc("event_id"))
    out = events.withColumns({"seq": F.row_number().over(in_time()).cast("long"), "_back": F.row_number().over(back)})
    return out.where(F.col("_back") <= last).drop("_back")


def logged(events: DataFrame, last: int, *fields: str) -> DataFrame:
    """A log: an event that equals the one before in all fields is left out, the others get ``seq`` from 1, and
    the last of them stay, 20 at least."""
    return numbered(changes(events, *fields), max(20, last))


def latest(events: DataFrame) -> DataFrame:
    """The last event of each job."""
    back = Window.partitionBy("job").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_at", F.row_number().over(back)).where("_at = 1").drop("_at")


def monotone_progress(events: DataFrame, top: int = 99) -> DataFrame:
    """``shown``: the largest progress so far, at most ``top``."""
    upto = in_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("shown", F.max(F.least("progress", F.lit(top))).over(upto))


def until_terminal(events: DataFrame, terminal: str) -> DataFrame:
    """Events up to and with the first of the terminal status."""
    before = in_time().rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max((F.col("status") == terminal).cast("int")).over(before), F.lit(0))
    return events.withColumn("_seen", seen).where("_seen = 0").drop("_seen")


def admissions(events: DataFrame, key: str, seconds: int, limit: int, budget: int) -> DataFrame:
    """``admitted``: whether a request may go at once, by the requests admitted in the seconds before it.

    A request counts with its ``tokens``, 1 at least and the budget at most; those that
    were not admitted use up nothing. A key's requests depend on one another and are one fold.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(F.col(key).alias("key"), "event_id", at.alias("at"), F.least(F.greatest(F.coalesce(F.col("tokens").cast("long"), F.lit(1)), F.lit(1)), F.lit(budget)).alias("tokens"))

    def fold(frame):
        import collections

        frame = frame.sort_values(["at", "event_id"], kind="stable")
        recent, used, out = collections.deque(), 0, []
        for moment, tokens in zip(frame["at"], frame["tokens"], strict=True):
            while recent and recent[0][0] < moment - seconds * 1_000_000:
                used -= recent.popleft()[1]
            fits = len(recent) < limit and used + tokens <= budget
            if fits:
                recent.append((moment, tokens))
                used += tokens
            out.append(fits)
        return frame.assign(admitted=out)[["key", "event_id", "admitted"]]

    return rows.groupBy("key").applyInPandas(fold, "key long, event_id long, admitted boolean")


def breaker(events: DataFrame, failing: str, after: int) -> DataFrame:
    """``run``: consecutive failing events that end here, and whether the breaker is open."""
    upto = in_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = events.withColumn("_group", F.sum((F.col("status") != failing).cast("long")).over(upto))
    within = Window.partitionBy("job", "_group").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("run", F.sum((F.col("status") == failing).cast("long")).over(within)).withColumn("open", F.col("run") >= after).drop("_group")


def alive(events: DataFrame, seconds: int) -> DataFrame:
    """Spans in which a job's events keep it alive: each extends its life by so many seconds."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = events.withColumn("_at", at)
    late = F.col("_at") - F.lag("_at").over(in_time()) >= seconds * 1_000_000
    upto = in_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = timed.withColumn("_late", F.coalesce(late, F.lit(False)).cast("long")).withColumn("span", F.sum("_late").over(upto))
    return spans.groupBy("job", "span").agg(F.count("*").alias("n"), F.min("_at").alias("first"), (F.max("_at") + seconds * 1_000_000).alias("expires"))


def before_deadline(events: DataFrame, cost: str, total: int) -> DataFrame:
    """Events that begin before the job's summed cost reaches the total."""
    before = in_time().rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("spent", F.coalesce(F.sum(cost).over(before), F.lit(0))).where(F.col("spent") < total)

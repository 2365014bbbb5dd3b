"""Joins that line records up: pages by shift, texts by correction, jobs by queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _alike(a: str, b: str) -> Column:
    """How well two page sizes agree: by ratio, by scale, and in points; 0 to 3."""
    aw, ah, bw, bh = (F.col(f"{t}.{n}").cast("double") for t in (a, b) for n in ("width", "height"))
    ratio_a, ratio_b, scale_w, scale_h = aw / ah, bw / bh, aw / bw, ah / bh
    ratio = F.abs(ratio_a - ratio_b) <= F.greatest(ratio_a, ratio_b, F.lit(1.0)) * 0.03
    scale = F.abs(scale_w - scale_h) <= F.greatest(scale_w, scale_h, F.lit(1.0)) * 0.08
    points = (F.abs(aw - bw) <= 2) & (F.abs(ah - bh) <= 2)
    usable = (aw > 0) & (ah > 0) & (bw > 0) & (bh > 0)
    return F.when(usable, ratio.cast("long") + scale.cast("long") + points.cast("long")).otherwise(0)


def page_shift(payload: DataFrame, own: DataFrame) -> DataFrame:
    """For each page of a payload (doc, page, width, height) the page ``target`` of its document.

    All differences between the two sides' page numbers, and 0, -1 and 1, are tried as a
    shift of the whole document. The best has the most pages on both sides, then the most
    agreement of sizes, then the page itself on the other side, then no shift, then the
    least, then the lower one. ``target`` is null where neither the shifted nor the
    unshifted page exists. A document's pages are few, so its pairs are bounded.
    """
    hit = payload.alias("a").join(own.alias("b"), F.col("a.doc") == F.col("b.doc"))
    shifts = hit.groupBy(F.col("a.doc").alias("doc"), (F.col("b.page") - F.col("a.page")).alias("shift")).agg(F.count("*").alias("hits"), F.sum(_alike("a", "b")).alias("score"))
    tried = payload.select("doc").distinct().select("doc", F.explode(F.array(*(F.lit(v).cast("long") for v in (-1, 0, 1)))).alias("shift"))
    every = shifts.unionByName(tried.select("doc", "shift", F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("score")))
    every = every.groupBy("doc", "shift").agg(F.max("hits").alias("hits"), F.max("score").alias("score"))
    pages = own.select("doc", F.col("page").alias("target")).distinct().withColumn("there", F.lit(True))
    moved = payload.select("doc", "page").join(every, "doc").withColumn("target", F.col("page") + F.col("shift")).join(pages, ["doc", "target"], "left")
    key = F.struct("hits", "score", F.coalesce("there", F.lit(False)).alias("there"), (F.col("shift") == 0).alias("unmoved"), (-F.abs("shift")).alias("near"), (-F.col("shift")).alias("low"))
    best = moved.groupBy("doc", "page").agg(F.max(key).alias("k"))
    same = pages.select("doc", F.col("target").alias("page"), F.col("there").alias("same"))
    target = F.when(F.col("k.there"), F.col("page") - F.col("k.low")).when(F.col("same"), F.col("page"))
    return best.join(same, ["doc", "page"], "left").select("doc", "page", target.alias("target"))


def corrected(texts: DataFrame, corrections: DataFrame, *key: str) -> DataFrame:
    """``text`` replaced by the last correction of its key (by ``seq``) that is not blank; unknown keys are ignored."""
    usable = corrections.withColumn("new", F.trim("new")).where("new <> ''")
    last = usable.groupBy(*key).agg(F.max(F.struct("seq", "new")).alias("c")).select(*key, F.col("c.new").alias("new"))
    return texts.join(last, list(key), "left").withColumn("text", F.coalesce("new", "text")).drop("new")


def queue_states(jobs: DataFrame, queued: DataFrame, started: DataFrame) -> DataFrame:
    """``position`` of each job in its queue and its state.

    ``queued`` (queue, at, job) counts entries of unknown jobs and of jobs that wait or
    run; a job that is queued twice has its last place. States in order: queued, running
    (by status or as started), waiting, done.
    """
    known = queued.join(jobs.select("job", "status"), "job", "left").where(F.col("status").isNull() | F.col("status").isin("pending", "processing"))
    placed = known.withColumn("place", F.row_number().over(Window.partitionBy("queue").orderBy("at", "job")).cast("long"))
    places = placed.groupBy("job").agg(F.max("place").alias("position"))
    runs = started.select("job").distinct().withColumn("started", F.lit(True))
    out = jobs.join(places, "job", "left").join(runs, "job", "left")
    state = F.when(F.col("position").isNotNull(), "queued").when((F.col("status") == "processing") | F.col("started"), "running").when(F.col("status") == "pending", "waiting").otherwise("done")
    return out.withColumn("state", state).drop("started")

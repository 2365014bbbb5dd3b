"""Mixing sources to target weights with hash-threshold histograms.

Each source's target is its share of the mix, capped by how often its words may be
repeated. Whole copies of a source come first; what is left of its target is a
budget, and the documents below a hash threshold get one copy more. Thresholds are
found by nested histograms, so rows are filtered and never sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh
from .scratch import Scratch
from .thresholds import budget_thresholds

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 48


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> dict[str | None, float]:
    """Words wanted of each source. Sources in order of code points, null last, take the weights in
    turn; a target over ``most`` times its source stops there and the rest is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped: dict[str | None, float] = {}
    while True:
        free = [s for s in order if s not in capped]
        rest = share * sum(sizes.values()) - sum(capped.values())
        total = sum(weight[s] for s in free)
        got = {s: rest * weight[s] / total for s in free}
        above = {s: float(most * sizes[s]) for s in free if got[s] > most * sizes[s]}
        if not above:
            return capped | got
        capped |= above


def _group() -> Column:
    """A source's name with ``=`` before it; null has a name of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def _key() -> Column:
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - KEY_BITS)


def _plan(scratch: Scratch, rows: DataFrame, weights: Sequence[float], share: float) -> DataFrame:
    """For each source its size, target, whole copies and the hash threshold of one copy more."""
    sizes = {r["group"]: r["size"] for r in rows.groupBy("group").agg(F.sum("weight").alias("size")).collect()}
    wanted = targets({None if g == "null" else g[1:]: n for g, n in sizes.items()}, weights, share) if sizes else {}
    plan = []
    for g, size in sizes.items():
        target = wanted[None if g == "null" else g[1:]]
        copies = min(MOST_REPEATS, int(target // size)) if size else 0
        plan.append((g, size, target, copies, target - copies * size if copies < MOST_REPEATS else 0.0))
    known = scratch.keep("plan", rows.sparkSession.createDataFrame(plan, "group string, source_size long, target double, copies int, budget double"))
    limits = budget_thresholds(scratch, rows, known.select("group", "budget"), KEY_BITS, nearest=True)
    return scratch.keep("merged", known.join(limits, "group"))


def _times(key: Column) -> Column:
    return F.col("copies") + F.when((F.col("copies") < MOST_REPEATS) & (key < F.col("threshold")), 1).otherwise(0)


def mix_sources(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document.

    ``size`` counts words (null text: 0) and ``taken`` the words the mix takes of the
    row, repeats counted: 0, 1 or 2 times its size. A source's taken words miss its
    target by less than the size of one boundary document (of all equal rows with one
    doc_id and text, which share a hash). The hash depends on doc_id and text alone,
    so reruns agree. A null source is a source. One row for each source reaches the
    driver. Other columns are not read.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    rows = scratch.keep("rows", documents.select("doc_id", _group().alias("group"), word_count("text").alias("weight"), _key().alias("key")))
    plan = _plan(scratch, rows, weights, share)
    return rows.join(plan, "group").select("doc_id", F.col("weight").alias("size"), "source_size", "target", (F.col("weight") * _times(F.col("key"))).alias("taken"))


def mixed(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, all columns as they were.

    Texts are filtered in place by their hash and are not shuffled by it. Documents
    without words carry nothing to mix and stay once; an empty table stays empty.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    rows = scratch.keep("rows", documents.select(_group().alias("group"), word_count("text").alias("weight"), _key().alias("key")))
    own, plan_of, copy = fresh(documents, "group"), fresh(documents, "plan"), fresh(documents, "copy")
    plan = _plan(scratch, rows, weights, share).select(F.col("group").alias(own), F.struct("copies", "threshold").alias(plan_of))
    more = (F.col(f"{plan_of}.copies") < MOST_REPEATS) & (_key() < F.col(f"{plan_of}.threshold"))
    times = F.when(word_count("text") == 0, 1).otherwise(F.col(f"{plan_of}.copies") + F.when(more, 1).otherwise(0))
    # a row for each source
    joined = documents.withColumn(own, _group()).join(F.broadcast(plan), own)
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col(f"`{c}`") for c in documents.columns])

"""Importance resampling with hashed n-gram models and Gumbel top-k.

Words and word pairs of a text (A-Z folded) are hashed into CELLS buckets. One bag
model is counted over every document, one over a bounded sample of labelled
documents of good quality that are not toxic. A text's log weight is the mean log
ratio of its n-grams under both models, times CHUNK, so that length does not
decide. Keys are log weights plus Gumbel noise from a hash of the row, and the k
largest keys are a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Text, array_chunks, chunks, inner, mix, windows
from .scratch import Scratch
from .thresholds import budget_thresholds

CELLS = 16_384
#: Bound of the labelled target rows, the first by a hash of doc_id.
TARGET_SAMPLE = 20_000
CHUNK = 128
KEY_BITS = 60


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The cells of all words and word pairs, and the text each belongs to; null reads as empty."""
    text = Text(column)
    starts, ends = text.words()
    counts = text.between(starts)
    words = text.hashes(starts, ends, fold=True)
    own = np.repeat(np.arange(text.n), counts)
    pair = inner(counts, 2, len(words))
    found = np.concatenate([windows(words, 1), windows(words, 2)[pair]])
    return (found >> np.uint64(50)).astype(np.int64), np.concatenate([own, own[: len(pair)][pair]])


def _counted(rows: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                total += np.bincount(ngrams(part.column(0))[0], minlength=CELLS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    out = np.zeros(CELLS)
    # CELLS rows at most
    for r in rows.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Of each cell, with a count added to both sides in proportion to the raw model."""
    base = (raw + 1) / (raw.sum() + CELLS)
    return np.log((target + CELLS * base) / (target.sum() + CELLS)) - np.log(base)


def importance(documents: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, n_ngrams, log_weight, sample_key and selected of every document.

    ``share`` of all documents is selected; by default the share of rows of good
    quality among the labelled ones. Null and wordless texts weigh -infinity and are never
    selected. Equal rows share a key and are selected together; keys count to 60
    bits. Without labels every weight is 0 and every document with a word may be
    drawn. Other columns are not read.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "importance")
    good = (F.col("quality") > 0) & (F.coalesce("toxic", F.lit(0)) == 0)
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min(good.cast("int")).alias("good"), F.min((F.col("quality") > 0).cast("int")).alias("fine"))
    chosen = marked.where("good = 1").orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(TARGET_SAMPLE)
    if share is None:
        seen = marked.agg(F.count("*").alias("n"), F.sum("fine").alias("fine")).first()
        share = (seen["fine"] or 0) / seen["n"] if seen["n"] else 1.0
    raw = _counted(documents)
    # chosen has TARGET_SAMPLE ids at most
    ratio = log_ratio(_counted(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")), raw)

    @F.arrow_udf("n_ngrams long, log_weight double, sample_key double, order long")
    def weigh(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, seed in columns:
            n, mean = np.zeros(0, np.int64), np.zeros(0)
            for part in array_chunks(column):
                cells, own = ngrams(part)
                many = np.bincount(own, minlength=len(part))
                n = np.concatenate([n, many])
                mean = np.concatenate([mean, np.bincount(own, ratio[cells], len(part)) / np.maximum(1, many)])
            weight = np.where(n > 0, CHUNK * mean, -np.inf)
            uniform = ((mix(seed.to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(11)).astype(float) + 0.5) / 2**53
            key = weight - np.log(-np.log(uniform))
            # doubles in descending order as ascending integers of 60 bits
            bits = np.where(key == 0, 0.0, key).view(np.uint64)
            ascending = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
            order = (~ascending >> np.uint64(64 - KEY_BITS)).astype(np.int64)
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(weight), pa.array(key), pa.array(order)], names=["n_ngrams", "log_weight", "sample_key", "order"])

    scored = scratch.keep("scored", documents.select("doc_id", weigh("text", F.xxhash64("doc_id", "text")).alias("_w")).select("doc_id", "_w.*"))
    total = scored.count()
    drawn = scored.where("n_ngrams > 0").select(F.lit("all").alias("group"), F.col("order").alias("key"), F.lit(1).cast("long").alias("weight"))
    budgets = spark.range(1).select(F.lit("all").alias("group"), F.lit(int(round(share * total))).cast("long").alias("budget"))
    limit = budget_thresholds(scratch, drawn, budgets, KEY_BITS).first()["threshold"]
    return scored.select("doc_id", "n_ngrams", "log_weight", "sample_key", ((F.col("order") < F.lit(limit)) & (F.col("n_ngrams") > 0)).alias("selected"))

"""Shards as runs of a Hilbert curve through metadata.

Source, language, size and id are quantised to eight bits each, a row's place is
its index on the Hilbert curve through these four dimensions, and the ordered rows
are cut into runs whose counts differ by one at most. Neighbours on the curve are
near in every dimension, so files made of runs have narrow ranges of each and a
reader can skip most of them by any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .ordering import ranked
from .scratch import Scratch

SHARDS = 24
BITS = 8
LAW = "rows"


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of integer points (rows x dimensions), by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


@F.arrow_udf(LongType())
def _curve(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
    return pa.array(hilbert(np.stack([v.to_numpy(zero_copy_only=False) for v in (a, b, c, d)], 1)))


def _placed(documents: DataFrame, *more: Column) -> DataFrame:
    """Every document's digest and place on the curve; null metadata is a value of its own."""
    span = documents.agg(F.min("doc_id").cast("double").alias("low"), F.max("doc_id").cast("double").alias("high")).first()
    low, width = span["low"] or 0.0, max(1.0, (span["high"] or 0.0) - (span["low"] or 0.0))
    top = (1 << BITS) - 1
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8

    def hashed(column: str) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(column), F.lit(top)) + 1, F.lit(0))

    # twelve steps for each doubling of the size, so 255 are reached at 2.5 MB
    by_size = F.least(F.lit(top), F.floor(12 * F.log2(size.cast("double"))))
    by_id = F.coalesce(F.floor(F.lit(top) * (F.col("doc_id").cast("double") - F.lit(low)) / F.lit(width)), F.lit(0))
    source = F.when(F.col("source").isNull(), 0).otherwise(hashed("source")).cast("long")
    lang = F.when(F.col("lang").isNull(), 0).otherwise(hashed("lang")).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return documents.select("doc_id", size.alias("size"), crc.alias("text_crc32"), _curve(source, lang, by_size.cast("long"), by_id.cast("long")).alias("curve"), *more)


def hilbert_shards(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    The law is ``rows``: shard s has the places from ceil(s * n / shards) on, so counts
    are at most one apart. Rows with one curve index are in order of doc_id, then
    text_crc32; equal rows may stand in either order, which no column tells. Null text
    has 0 bytes. Empty tables give no rows. Columns other than doc_id, text, source and
    lang are not read.
    """
    scratch = Scratch(documents.sparkSession, "shards")
    rows = ranked(scratch, _placed(documents), "curve", "doc_id", "text_crc32")
    total = scratch.spark.read.parquet(scratch.path("ranked")).count()
    shard = F.expr(f"cast((rank * {shards}L) div {max(1, total)}L as int)")
    first = F.expr(f"(cast(shard as long) * {total}L + {shards - 1}L) div {shards}L")
    return rows.withColumn("shard", shard).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write whole documents as Parquet, a folder ``shard=s`` for each run, in curve order.

    The cut points on the curve come from the digest, so texts move once, to the
    range partitions of their runs.
    """
    digest = _placed(documents).select(F.struct("curve", "doc_id", "text_crc32").alias("key"))
    scratch = Scratch(documents.sparkSession, "shard-cuts")
    rows = ranked(scratch, digest, "key")
    total = rows.count()
    marks = [(s * total + shards - 1) // shards for s in range(1, shards)]
    # at most shards - 1 rows
    cuts = sorted(tuple(r["key"]) for r in rows.where(F.col("rank").isin(marks)).select("key").collect())
    shard = F.lit(0)
    for curve, doc_id, crc in cuts:
        after = F.struct(F.lit(curve).alias("curve"), F.lit(doc_id).cast("long").alias("doc_id"), F.lit(crc).alias("text_crc32"))
        shard = shard + (F.struct("curve", F.col("doc_id").cast("long").alias("doc_id"), "text_crc32") >= after).cast("int")
    place = _placed(documents, F.struct(*documents.columns).alias("_row"))
    ordered = place.withColumn("shard", shard).repartitionByRange("shard", "curve", "doc_id").sortWithinPartitions("shard", "curve", "doc_id")
    ordered.select("shard", "_row.*").write.partitionBy("shard").parquet(path)

"""Token ids as Parquet list columns.

Documents are range-partitioned by doc_id, encoded, and written in that order by
Spark's Parquet writer: format version 2 without dictionaries stores the ids with
delta encoding, row groups and pages have stated sizes, and the page indexes let a
reader fetch chosen columns and rows alone. A file's rows carry the number of ids
before them in their shard; the shards' own offsets are a small table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .bytetext import chunks, lists
from .ordering import offsets
from .scratch import Scratch, arrow_rows
from .tokens import DEFAULT_TOKENIZER, crc, encoder, ended

END_ID = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
#: Rows of ids that one Arrow batch takes back.
READ_ROWS = 500
COLUMNS = "doc_id long, shard int, shard_start long, n_tokens int, ids array<int>"


def write_tokens(documents: DataFrame, path: str, tokenizer: str = DEFAULT_TOKENIZER, encoding: str = "delta", end_id: int | None = END_ID) -> None:
    """Write doc_id, shard, shard_start, n_tokens and ids (``end_id`` appended) in ascending doc_id order.

    ``encoding`` is ``delta`` or ``dictionary``. Null text is empty; a null doc_id
    comes first; rows of one doc_id stand in order of a hash of their text.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        done = 0
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, counts = library.encode(part.column("text").to_pylist())
                if end_id is not None:
                    ids, counts = ended(ids, counts, end_id)
                n = counts.astype(np.int32)
                start = done + np.cumsum(counts) - counts
                done += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.full(len(n), shard, np.int32)), pa.array(start), pa.array(n), lists(pa.array(ids.view(np.int32)), n)],
                    ["doc_id", "shard", "shard_start", "n_tokens", "ids"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    (
        ordered.mapInArrow(encode, COLUMNS)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .parquet(path)
    )


def read_tokens(scratch: Scratch, path: str) -> DataFrame:
    """The written rows with ``start``, the ids of all documents before them in doc_id order."""
    files = scratch.spark.read.schema(COLUMNS).parquet(path)
    before = scratch.keep("shards", offsets(files.select("shard", "n_tokens"), "shard", "n_tokens"))
    return files.join(before, "shard").withColumn("start", F.col("before") + F.col("shard_start"))


@F.arrow_udf(LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
    at = ids.offsets.to_numpy()
    return pa.array([crc(values[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())


def token_output(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from files written and read back.

    Null and empty texts have the end id alone. Repeated rows keep a row each. Other
    columns are not read.
    """
    scratch = Scratch(documents.sparkSession, "tokens")
    write_tokens(documents, scratch.path("ids"), tokenizer)
    back = read_tokens(scratch, scratch.path("ids"))
    digest = back.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), ids_crc32("ids").alias("ids_crc32"))
    with arrow_rows(documents.sparkSession, READ_ROWS):
        return scratch.keep("digest", digest)

"""Best-fit packing with certified bin counts.

Pieces are dealt to partitions of bounded size and each is packed by best-fit
decreasing. Dual feasible functions give a lower bound on the bins any packing of
the partition needs: a partition that meets its bound is certified. The others
keep their full bins, exchange the documents of the rest by a new deal, and are
packed again, as long as a round saves a bin, and one in WORTH of those dealt anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import chunks
from .scratch import Scratch
from .tokens import DEFAULT_TOKENIZER, crc, encoder, ended

CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs, about; its memory is a few dozen bytes for each.
PIECES_PER_TASK = 50_000
#: A round of exchange that saves fewer than one in so many of the loose bins is the last.
WORTH = 1000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    rest = [(at, capacity) for at in range(first, n, capacity)]
    return [(0, first), *rest] if first else rest


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """A row for each piece of each document: its ids' place, number and crc32. Null text has the end id alone."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer)
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                ids, counts = ended(*library.encode(part.column("text").to_pylist()), END_ID)
                for doc_id, end, total in zip(part.column("doc_id").to_pylist(), np.cumsum(counts).tolist(), counts.tolist(), strict=True):
                    first = end - total
                    rows += [(doc_id, i, at, n, crc(ids[first + at : first + at + n])) for i, (at, n) in enumerate(cut(total, capacity))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, PIECE)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the place of each piece, and what is left of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left: list[int] = []
    with_left: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_bits = 0  # bit r is set while a bin has r left
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_bits >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = with_left[room].pop()
            if not with_left[room]:
                open_bits &= ~(1 << room)
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], place[i] = b, capacity - room
        left[b] = room - n
        with_left[room - n].append(b)
        open_bits |= 1 << (room - n)
    return bins, place, np.array(left, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the dual feasible functions u_k after U_eps.

    U_eps sends pieces under eps to 0 and those over capacity - eps to a whole bin;
    u_k sends x to x if (k + 1) x is whole, else to floor((k + 1) x) / k. Sums are of integers.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(count @ x) // capacity)
    many, total = np.cumsum(count[::-1])[::-1], np.cumsum((count * x)[::-1])[::-1]
    eps = np.arange(1, capacity // 2 + 1)
    over = many[capacity - eps + 1]
    middle = total[eps] - total[capacity - eps + 1]
    best = max(best, int((over + -(-middle // capacity)).max()))
    for k in range(1, 33):
        scaled = (k + 1) * x
        u = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)  # times k * capacity
        sums = np.cumsum((count * u)[::-1])[::-1]
        value = over * k * capacity + sums[eps] - sums[capacity - eps + 1]
        best = max(best, -(-int(value.max()) // (k * capacity)))
    return best


def _packed(pieces: DataFrame, deal: Column, parts: int, capacity: int, turn: int) -> DataFrame:
    """Deal the pieces to ``parts`` tasks and pack each task's own."""
    names = [f.name for f in pieces.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).select(names).combine_chunks()
        lengths = table.column("length").to_numpy()
        bins, place, left = best_fit(lengths, capacity)
        base = (turn << 56) + (TaskContext.get().partitionId() << 32)
        gap = len(left) - lower_bound(lengths, capacity)
        for name, values in (("sequence_id", base + bins), ("offset", place), ("room", left[bins]), ("gap", np.full(len(bins), gap))):
            table = table.append_column(name, pa.array(values, pa.int64()))
        yield from table.to_batches()

    return pieces.repartition(parts, deal).mapInArrow(pack, f"{schema}, sequence_id long, offset long, room long, gap long")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and gap of every piece of every document.

    ``gap`` is the number of bins over the lower bound in the task that packed the piece
    last; 0 certifies that no packing of that task's pieces has fewer.

    Pieces of the whole capacity are sequences of their own. Null and empty texts are
    a piece of the end id alone; repeated rows and ids are packed as rows of their
    own; an empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(documents.sparkSession, "packing")
    pieces = scratch.keep("pieces", token_pieces(documents, capacity, tokenizer).withColumn("row", F.monotonically_increasing_id()))
    short = pieces.where(F.col("length") < capacity)
    parts = max(1, round(short.count() / PIECES_PER_TASK))
    state = scratch.keep("packed0", _packed(short, F.xxhash64("row"), parts, capacity, 0))
    turn = 0
    while True:
        turn += 1
        loose = (F.col("gap") > 0) & (F.col("room") > 0)
        before = state.where(loose).agg(F.count("*").alias("rows"), F.count_distinct("sequence_id").alias("bins"), F.count_distinct(F.shiftright("sequence_id", 32)).alias("tasks")).first()
        if before["tasks"] < 2:
            break  # nobody to exchange with
        parts = max(1, round(before["rows"] / PIECES_PER_TASK))
        again = scratch.keep(f"again{turn}", _packed(state.where(loose).select(*pieces.columns), F.xxhash64("row", F.lit(turn)), parts, capacity, turn))
        saved = before["bins"] - again.select("sequence_id").distinct().count()
        if saved <= 0:
            break
        state = scratch.keep(f"packed{turn}", state.where(~loose).unionByName(again))
        scratch.drop(f"packed{turn - 1}", f"again{turn}")
        if saved * WORTH < before["bins"]:
            break
    whole = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long"), "gap": F.lit(0).cast("long")})
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap")
    return state.select(*names).unionByName(whole.select(*names))

"""Tokens in pairs, boxes in bands, sizes of table columns and shifts of content pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import EMU_PER_POINT

#: Fixed value: the spread of grey from which a box is not flat.
FLAT = 5.0


def token_pairs(tokens: DataFrame, by: str, order: Sequence[str], kind: str, id: str) -> DataFrame:
    """``first`` and ``second`` of each pair of neighbours of different kinds; a token is in one pair at most.

    From the left, two neighbours of different kinds are taken together, and one of two
    alike is passed over. So a run in which every kind differs from the one before pairs
    off from its start, and a run begins where two are alike. Rows without a kind are no
    tokens.
    """
    line = Window.partitionBy(by).orderBy(*order)
    marked = tokens.where(F.col(kind).isNotNull()).withColumn("alike", F.coalesce(F.col(kind) == F.lag(kind).over(line), F.lit(False)).cast("long"))
    runs = marked.withColumn("run", F.sum("alike").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = Window.partitionBy(by, "run").orderBy(*order)
    placed = runs.select(by, F.row_number().over(run).alias("place"), F.col(id).alias("first"), F.lead(id).over(run).alias("second"))
    return placed.where("place % 2 = 1 and second is not null").select(by, "first", "second")


def bands(boxes: DataFrame, width: float) -> DataFrame:
    """``band`` from 0 of each box, in order of vertical centre, x0 and pos; ``median`` is the page's height of a line.

    A box joins the last band if it is no further off sideways than 6 medians or a 25th
    of the page's width, and its centre is within 0.55 medians of the band's mean or it
    shares 0.35 of the smaller height. A page is one fold over its boxes, whose number
    is bounded.
    """
    names = ("x0", "y0", "x1", "y1")
    row = F.struct(((F.col("y0") + F.col("y1")) / 2.0).alias("c"), *(F.col(n).cast("double").alias(n) for n in names), "pos")
    row = F.struct(F.col("r.c"), F.col("r.x0").alias("x"), F.col("r.pos").alias("pos"), F.col("r"))
    pages = boxes.withColumn("r", F.struct(((F.col("y0") + F.col("y1")) / 2.0).alias("c"), *(F.col(n).cast("double").alias(n) for n in names), "pos"))
    pages = pages.groupBy("page").agg(F.max("median").cast("double").alias("m"), F.sort_array(F.collect_list(row)).alias("s"))
    zero = [F.lit(0.0).alias(n) for n in names]
    start = F.struct(*zero, F.lit(0.0).alias("mean"), F.lit(0.0).alias("n"), F.lit(-1).cast("long").alias("band"), F.expr("cast(array() as array<struct<pos:bigint,band:bigint>>)").alias("done"))

    def step(acc: Column, item: Column) -> Column:
        b = item["r"]
        sideways = F.greatest(acc["x0"] - b["x1"], b["x0"] - acc["x1"], F.lit(0.0))
        shared = F.least(b["y1"], acc["y1"]) - F.greatest(b["y0"], acc["y0"])
        smaller = F.least(F.greatest(F.lit(1.0), acc["y1"] - acc["y0"]), F.greatest(F.lit(1.0), b["y1"] - b["y0"]))
        near = (F.abs(b["c"] - acc["mean"]) <= 0.55 * F.col("m")) | (shared >= 0.35 * smaller)
        joins = (acc["n"] > 0) & (sideways <= F.greatest(F.lit(0.04 * width), 6.0 * F.col("m"))) & near
        band = F.when(joins, acc["band"]).otherwise(acc["band"] + 1)
        return F.struct(
            *(F.when(joins, (F.least if n in ("x0", "y0") else F.greatest)(acc[n], b[n])).otherwise(b[n]).alias(n) for n in names),
            F.when(joins, (acc["mean"] * acc["n"] + b["c"]) / (acc["n"] + 1.0)).otherwise(b["c"]).alias("mean"),
            F.when(joins, acc["n"] + 1.0).otherwise(1.0).alias("n"),
            band.alias("band"),
            F.concat(acc["done"], F.array(F.struct(item["pos"].alias("pos"), band.alias("band")))).alias("done"),
        )

    return pages.select("page", F.explode(F.aggregate("s", start, step, lambda acc: acc["done"])).alias("b")).select("page", "b.pos", "b.band")


def table_sizes(cells: DataFrame, by: str, rows: int, cols: int, width: float, height: float, wide: Column, high: Column, scale: float = 1.0) -> DataFrame:
    """``emu`` of each column and row of a table: its widest and highest cell, or equal parts of the page where no cell has a size.

    Cells outside of the grid do not count. Columns and rows without a cell are 0 wide
    where others have a size. ``wide`` and ``high`` are the table's own size in EMU, by
    ``by``; what is missing or too much goes to the last column and row, and no size is
    below 0.
    """
    inside = cells.where(f"r >= 0 and r < {rows} and c >= 0 and c < {cols}")
    sized = inside.select(by, F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(i).cast("long").alias("place"), size.cast("double").alias("size")) for a, i, size in (("col", "c", F.col("x1") - F.col("x0")), ("row", "r", F.col("y1") - F.col("y0")))))).alias("s")).select(by, "s.*")
    widest = sized.groupBy(by, "axis", "place").agg(F.greatest(F.max("size"), F.lit(0.0)).alias("size"))
    grid = F.array(*(F.struct(F.lit(axis).alias("axis"), F.lit(i).cast("long").alias("place"), F.lit(whole / n).alias("equal")) for axis, n, whole in (("col", cols, width), ("row", rows, height)) for i in range(n)))
    every = cells.select(by).distinct().select(by, F.explode(grid).alias("g")).select(by, "g.*")
    joined = every.join(widest, [by, "axis", "place"], "left").withColumn("size", F.coalesce("size", F.lit(0.0)))
    whole = F.sum("size").over(Window.partitionBy(by, "axis"))
    size = F.when(whole > 0, F.col("size")).otherwise(F.col("equal"))
    rounded = joined.select(by, "axis", "place", F.bround(size * EMU_PER_POINT * scale, 0).cast("long").alias("emu"))
    last = F.col("place") == F.when(F.col("axis") == "col", cols - 1).otherwise(rows - 1)
    missing = F.when(F.col("axis") == "col", wide).otherwise(high) - F.sum("emu").over(Window.partitionBy(by, "axis"))
    return rounded.select(by, "axis", "place", F.greatest(F.lit(0), F.col("emu") + F.when(last, missing).otherwise(0)).cast("long").alias("emu"))


def overlay_stats(boxes: DataFrame, by: str, width: int, height: int, scale_x: float, scale_y: float) -> DataFrame:
    """Of the boxes drawn on a page's picture: how many leave it, how many are flat, and the upper median of ``std``.

    Boxes that have no area on the picture are counted as leaving it alone. A page
    without a drawn box has no median.
    """
    sides = [F.bround(F.col(n) * F.lit(s), 0).cast("long").alias(n) for n, s in (("x0", scale_x), ("y0", scale_y), ("x1", scale_x), ("y1", scale_y))]
    pixels = boxes.select(by, F.col("std").cast("double").alias("std"), *sides)
    drawn = (F.least(F.lit(width), F.greatest(F.lit(0), "x1")) > F.greatest(F.lit(0), F.least(F.lit(width - 1), "x0"))) & (F.least(F.lit(height), F.greatest(F.lit(0), "y1")) > F.greatest(F.lit(0), F.least(F.lit(height - 1), "y0")))
    outside = (F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") > width) | (F.col("y1") > height)
    spreads = F.sort_array(F.collect_list(F.when(drawn, F.col("std"))))
    return pixels.groupBy(by).agg(F.count_if(outside).alias("outside"), F.count_if(drawn & (F.col("std") <= FLAT)).alias("flat"), spreads.alias("s")).select(by, "outside", "flat", F.get("s", F.expr("int(size(s) div 2)")).alias("median_std"))


def content_shift(items: DataFrame, sizes: DataFrame, ranges: DataFrame) -> DataFrame:
    """``shift`` of a document's item pages (doc, page): of 0, -1, 1, and the first wanted page and the one before it.

    The best has the most items in the wanted range (doc, start, end, from 1; null for
    all), then on pages of known size, then on pages from 0, then no shift, then the
    least, then the lower one. A document without a range may have no row in it.
    """
    pages = items.groupBy("doc", "page").agg(F.count("*").alias("n")).join(ranges, "doc", "left")
    first, last = (F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), F.col(c) - 1) for c in ("start", "end"))
    shifts = F.array_distinct(F.filter(F.array(*(F.lit(v).cast("long") for v in (0, -1, 1)), first, first - 1), lambda v: v.isNotNull()))
    tried = pages.select("doc", "page", "n", first.alias("first"), last.alias("last"), F.explode(shifts).alias("shift")).withColumn("to", F.col("page") + F.col("shift"))
    known = sizes.select("doc", F.col("page").alias("to")).distinct().withColumn("known", F.lit(True))

    def hits(met: Column) -> Column:
        return F.sum(F.when(met, F.col("n")).otherwise(0))

    scores = tried.join(known, ["doc", "to"], "left").groupBy("doc", "shift").agg(hits(F.col("to").between(F.col("first"), F.col("last"))).alias("a"), hits(F.col("known")).alias("b"), hits(F.col("to") >= 0).alias("c"))
    key = F.struct("a", "b", "c", (F.col("shift") == 0).alias("unmoved"), (-F.abs("shift")).alias("near"), (-F.col("shift")).alias("low"))
    return scores.groupBy("doc").agg(F.max(key).alias("k")).select("doc", (-F.col("k.low")).alias("shift"))

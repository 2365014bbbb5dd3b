"""Operators on page boxes. A page is the unit of work and the shuffle key throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo

BOX = ("page", "pos", "x0", "y0", "x1", "y1")


def reading_order(boxes: DataFrame) -> DataFrame:
    """``rank`` from 1 by vertical centre, then x0, then pos."""
    order = Window.partitionBy("page").orderBy(F.col("y0") + F.col("y1"), "x0", "pos")
    return boxes.withColumn("rank", F.row_number().over(order).cast("long"))


def layout_order(boxes: DataFrame, given: str) -> DataFrame:
    """``rank`` from 1 by a given order, nulls last, then top left."""
    order = Window.partitionBy("page").orderBy(F.col(given).asc_nulls_last(), "y0", "x0", "pos")
    return boxes.withColumn("rank", F.row_number().over(order).cast("long"))


def top_left(boxes: DataFrame) -> DataFrame:
    """``rank`` from 1 by y0, then x0, then pos."""
    order = Window.partitionBy("page").orderBy("y0", "x0", "pos")
    return boxes.withColumn("rank", F.row_number().over(order).cast("long"))


def of_kind(elements: DataFrame, column: str, kind: str) -> DataFrame:
    """The elements of a type, source or provider; null is none."""
    return elements.where(F.col(column) == kind)


def merge_primary(boxes: DataFrame, primary: Column, width: int, iou: float = 0.45, cover: float = 0.85) -> DataFrame:
    """All primary boxes, and of the others those that match none of their page.

    Boxes match by iou, by the share of the smaller one, or, where both have the size of
    a line against the upper median of the page's primary heights, by the other's centre
    lying in the primary box or 2 beside it.
    """
    first, rest = boxes.where(primary), boxes.where(~primary)
    heights = first.select("page", F.greatest(F.lit(1), F.col("y1") - F.col("y0")).alias("h"))
    ranked = heights.select("page", "h", F.row_number().over(Window.partitionBy("page").orderBy("h")).alias("at"), F.count("*").over(Window.partitionBy("page")).alias("n"))
    median = ranked.where(F.col("at") == upper_median()).select("page", F.greatest(F.lit(4.0), F.col("h").cast("double")).alias("_line"))
    sized = first.join(median, "page")
    x, y = (F.col("s.x0") + F.col("s.x1")) / 2.0, (F.col("s.y0") + F.col("s.y1")) / 2.0
    near = x.between(F.col("p.x0") - 2.0, F.col("p.x1") + 2.0) & y.between(F.col("p.y0") - 2.0, F.col("p.y1") + 2.0)
    lines = (F.greatest(F.lit(1), F.col("p.y1") - F.col("p.y0")) <= 2.2 * F.col("p._line")) & (F.greatest(F.lit(1), F.col("p.x1") - F.col("p.x0")) <= 0.98 * width) & (F.greatest(F.lit(1), F.col("s.y1") - F.col("s.y0")) <= 2.6 * F.col("p._line"))
    match = (F.col("s.page") == F.col("p.page")) & ((geo.iou("s", "p") >= iou) | (geo.cover("s", "p") >= cover) | (lines & near))
    return first.unionByName(rest.alias("s").join(sized.alias("p"), match, "left_anti"))


def merge_in_turn(boxes: DataFrame, source: str, ranking: Sequence[str], width: int) -> DataFrame:
    """Sources in order of preference: of each next one only the boxes that match nothing kept before."""
    kept = boxes.where(F.col(source) == ranking[0]).withColumn("_kept", F.lit(True))
    for name in ranking[1:]:
        rest = boxes.where(F.col(source) == name).withColumn("_kept", F.lit(False))
        kept = merge_primary(kept.unionByName(rest), F.col("_kept"), width).withColumn("_kept", F.lit(True))
    return kept.drop("_kept")


def pairs(boxes: DataFrame) -> DataFrame:
    """Overlapping pairs of a page, with intersection, iou and cover."""
    found = boxes.alias("a").join(boxes.alias("b"), (F.col("a.page") == F.col("b.page")) & (F.col("a.pos") < F.col("b.pos")) & geo.meets("a", "b"))
    return found.select(F.col("a.page").alias("page"), F.col("a.pos").alias("a"), F.col("b.pos").alias("b"), geo.overlap("a", "b").alias("inter"), geo.iou("a", "b").alias("iou"), geo.cover("a", "b").alias("cover"))


def region_stats(regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """Of each region the boxes that overlap it, those with their centre in it, and the area, capped by its own."""
    hit = (F.col("r.page") == F.col("b.page")) & geo.meets("r", "b")
    joined = regions.alias("r").join(boxes.alias("b"), hit, "left")
    found = F.col("b.pos").isNotNull()
    grouped = joined.groupBy(F.col("r.page").alias("page"), F.col("r.region").alias("region"), geo.area("r").alias("whole"))
    out = grouped.agg(F.count("b.pos").alias("overlapping"), F.sum((found & geo.centre_in("b", "r")).cast("long")).alias("centred"), F.sum(F.when(found, geo.overlap("r", "b")).otherwise(0)).alias("inter"))
    return out.select("page", "region", "overlapping", F.coalesce("centred", F.lit(0)).alias("centred"), F.least("inter", "whole").alias("covered"))


def suppressed(boxes: DataFrame, regions: DataFrame, cover: float = 0.86) -> DataFrame:
    """Boxes that no region of their page holds: neither by this share of their area nor by centre and half of it."""
    inside = geo.overlap("b", "r") / F.greatest(F.lit(1), geo.area("b"))
    hit = (F.col("b.page") == F.col("r.page")) & geo.meets("b", "r") & ((inside >= cover) | (geo.centre_in("b", "r") & (inside >= 0.5)))
    return boxes.alias("b").join(regions.alias("r"), hit, "left_anti")


def explained(regions: DataFrame, boxes: DataFrame, cover: float = 0.5) -> DataFrame:
    """Regions of which some box covers this share of the smaller area."""
    hit = (F.col("b.page") == F.col("r.page")) & geo.meets("b", "r") & (geo.cover("b", "r") >= cover)
    return regions.alias("r").join(boxes.alias("b"), hit, "left_semi")


def residual(boxes: DataFrame, grids: DataFrame) -> DataFrame:
    """Boxes whose centre no grid of their page holds."""
    hit = (F.col("b.page") == F.col("g.page")) & geo.centre_in("b", "g")
    return boxes.alias("b").join(grids.alias("g"), hit, "left_anti")


def best_match(regions: DataFrame, boxes: DataFrame, iou: float = 0.52, cover: float = 0.72) -> DataFrame:
    """Of each region the box that fits best: by the largest of iou and both covers, the lowest pos on ties.

    A box counts from this iou, or this share of either area; areas are 1 at least.
    """
    hit = (F.col("b.page") == F.col("r.page")) & geo.meets("b", "r")
    both = geo.overlap("r", "b")
    shares = [geo.iou("r", "b"), both / F.greatest(F.lit(1), geo.area("r")), both / F.greatest(F.lit(1), geo.area("b"))]
    found = regions.alias("r").join(boxes.alias("b"), hit).where((shares[0] >= iou) | (shares[1] >= cover) | (shares[2] >= cover))
    scored = found.select("r.page", "r.region", "b.pos", F.greatest(*shares).alias("score"))
    best = scored.groupBy("page", "region").agg(F.max(F.struct("score", (-F.col("pos")).alias("back"))).alias("top"))
    return best.select("page", "region", (-F.col("top.back")).alias("pos"), F.col("top.score").alias("score"))


def grid_cells(grids: DataFrame, boxes: DataFrame, rows: int, cols: int) -> DataFrame:
    """All cells of each grid with the number of box centres in them; the last cells hold the far edges."""
    cells = grids.select("page", "region", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("cell"))
    cells = cells.select("page", "region", F.expr(f"cell div {cols}").alias("r"), (F.col("cell") % cols).cast("long").alias("c"))
    x, y = F.col("b.x0") + F.col("b.x1"), F.col("b.y0") + F.col("b.y1")
    width, height = F.col("g.x1") - F.col("g.x0"), F.col("g.y1") - F.col("g.y0")
    hit = (F.col("g.page") == F.col("b.page")) & geo.centre_in("b", "g")
    placed = grids.alias("g").join(boxes.alias("b"), hit)
    r = F.least(F.floor((y - 2 * F.col("g.y0")) * rows / (2 * height)), F.lit(rows - 1))
    c = F.least(F.floor((x - 2 * F.col("g.x0")) * cols / (2 * width)), F.lit(cols - 1))
    counts = placed.groupBy(F.col("g.page").alias("page"), F.col("g.region").alias("region"), r.alias("r"), c.alias("c")).agg(F.count("*").alias("n"))
    return cells.join(counts, ["page", "region", "r", "c"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ordered_value(by: Sequence[str], value: str, place: Column, name: str, data: DataFrame) -> DataFrame:
    """The value at a place (from 1, of the group's n) in ascending order."""
    order = Window.partitionBy(*by).orderBy(value, "pos")
    ranked = data.select(*by, value, F.row_number().over(order).alias("at"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    return ranked.where(F.col("at") == place).select(*by, F.col(value).alias(name))


def upper_median() -> Column:
    return F.floor(F.col("n") / 2) + 1


def nearest_rank(p: float) -> Column:
    """Place of round-half-even((n - 1) p)."""
    return F.bround((F.col("n") - 1) * p).cast("long") + 1


def weighted_quantile(boxes: DataFrame, page_width: int, share: float = 0.6, low: int = 6, high: int = 48) -> DataFrame:
    """The first height at which the squared widths reach this share of their sum; of over 24 boxes the widest quarter counts.

    Heights outside 4.5 to 96 do not count, a width counts up to the page's and with a ten-thousandth at least
    of its square; a page without a box that counts has 12.
    """
    wide = Window.partitionBy("page").orderBy(F.desc("w"), "pos")
    sized = boxes.select("page", "pos", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    sized = sized.where((F.col("w") > 0) & F.col("h").between(4.5, 96.0))
    sized = sized.withColumns({"n": F.count("*").over(Window.partitionBy("page")), "at": F.row_number().over(wide)})
    kept = sized.where((F.col("n") <= 24) | (F.col("at") <= F.greatest(F.lit(12), F.bround(F.col("n") * 0.25))))
    width = F.least(F.lit(page_width), "w")
    weighed = kept.withColumn("weight", F.greatest(F.lit(page_width * page_width // 10_000), width * width))
    running = Window.partitionBy("page").orderBy("h", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = weighed.withColumns({"upto": F.sum("weight").over(running), "total": F.sum("weight").over(Window.partitionBy("page"))})
    found = summed.where(F.col("upto") >= share * F.col("total")).groupBy("page").agg(geo.clamp(F.min("h").cast("double"), float(low), float(high)).alias("size"))
    return boxes.select("page").distinct().join(found, "page", "left").withColumn("size", F.coalesce("size", F.lit(12.0)))


def x_segments(boxes: DataFrame, gap: int) -> DataFrame:
    """Boxes of a row in order of x0; a segment ends where the next box begins over ``gap`` after the last one's end."""
    order = Window.partitionBy("page", "row").orderBy("x0", "pos")
    fresh = F.when(F.col("x0") - F.lag("x1").over(order) > gap, 1).otherwise(0)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return boxes.withColumn("fresh", fresh).withColumn("segment", F.sum("fresh").over(upto)).drop("fresh")


def envelope(data: DataFrame, *by: str) -> DataFrame:
    return data.groupBy(*by).agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def first_of(data: DataFrame, *key: str) -> DataFrame:
    """The first row by pos of each key."""
    order = Window.partitionBy(*key).orderBy("pos")
    return data.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def multi_column(boxes: DataFrame, width: int) -> DataFrame:
    """Pages with at least 8 boxes, 3 of them in the left and 3 in the right, whose heights overlap."""
    centre = F.col("x0") + F.col("x1")
    left, right = centre < 0.9 * width, centre > 1.1 * width

    def of(part: Column, column: str, f) -> Column:
        return f(F.when(part, F.col(column)))

    out = boxes.groupBy("page").agg(F.count("*").alias("n"), F.sum(left.cast("long")).alias("left"), F.sum(right.cast("long")).alias("right"), *(of(p, c, f).alias(f"{k}{c}") for k, p in (("l", left), ("r", right)) for c, f in (("y0", F.min), ("y1", F.max))))
    both = F.least("ly1", "ry1") - F.greatest("ly0", "ry0")
    return out.where((F.col("n") >= 8) & (F.col("left") >= 3) & (F.col("right") >= 3) & (both > 70)).select("page", "n", "left", "right")


def _far(box: Column, other: Column, cover: float) -> Column:
    w = F.least(box["x1"], other["x1"]) - F.greatest(box["x0"], other["x0"])
    h = F.least(box["y1"], other["y1"]) - F.greatest(box["y0"], other["y0"])
    small = F.least((box["x1"] - box["x0"]) * (box["y1"] - box["y0"]), (other["x1"] - other["x0"]) * (other["y1"] - other["y0"]))
    return ~((w > 0) & (h > 0) & (w * h >= cover * F.greatest(small, F.lit(1))))


def greedy_dedup(boxes: DataFrame, cover: float = 0.7) -> DataFrame:
    """Boxes by descending confidence, then ascending area; a box goes if it covers a kept one this much.

    What goes depends on what is kept before, so a page is one fold over its sorted boxes.
    """
    row = F.struct((-F.col("confidence")).alias("c"), geo.area().alias("a"), "pos", "x0", "y0", "x1", "y1")
    page = boxes.groupBy("page").agg(F.sort_array(F.collect_list(row)).alias("s"))
    kept = F.aggregate("s", F.slice("s", 1, 0), lambda acc, b: F.when(F.forall(acc, lambda k: _far(b, k, cover)), F.concat(acc, F.array(b))).otherwise(acc))
    return page.select("page", F.explode(kept).alias("k")).select("page", "k.pos", "k.x0", "k.y0", "k.x1", "k.y1")


def page_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pages whose signature differs; a missing page differs from any."""
    joined = left.toDF("page", "before").join(right.toDF("page", "after"), "page", "full_outer")
    return joined.where(~F.col("before").eqNullSafe(F.col("after")))

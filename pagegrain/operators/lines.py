"""Grouping and merging of a page's boxes into lines. A page has a bounded number of boxes and is one unit of work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Boxes of a page from which components replace repeated merging.
MANY_BOXES = 240
#: Share of the smaller height that boxes of one line overlap by.
SAME_LINE = 0.4
#: Boxes of a page that are held against the others at once.
BLOCK = 512
_MERGED = "page long, x0 double, y0 double, x1 double, y1 double"


def y_lines(boxes: DataFrame, far: float) -> DataFrame:
    """``line`` from 0: boxes by vertical centre, a new line where one is over ``far`` from the running mean of the line's centres.

    Each step depends on all before it, so a page is one fold over its sorted boxes.
    """
    row = F.struct(((F.col("y0") + F.col("y1")) / 2.0).alias("c"), F.col("x0").cast("double").alias("x"), "pos")
    pages = boxes.groupBy("page").agg(F.sort_array(F.collect_list(row)).alias("s"))
    start = F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("n"), F.lit(-1).cast("long").alias("line"), F.expr("cast(array() as array<struct<pos:bigint,line:bigint>>)").alias("done"))

    def step(acc: Column, b: Column) -> Column:
        fresh = (acc["n"] == 0) | (F.abs(b["c"] - acc["mean"]) > far)
        line = F.when(fresh, acc["line"] + 1).otherwise(acc["line"])
        return F.struct(
            F.when(fresh, b["c"]).otherwise((acc["mean"] * acc["n"] + b["c"]) / (acc["n"] + 1.0)).alias("mean"),
            F.when(fresh, 1.0).otherwise(acc["n"] + 1.0).alias("n"),
            line.alias("line"),
            F.concat(acc["done"], F.array(F.struct(b["pos"].alias("pos"), line.alias("line")))).alias("done"),
        )

    return pages.select("page", F.explode(F.aggregate("s", start, step, lambda acc: acc["done"])).alias("b")).select("page", "b.pos", "b.line")


def _same_line(y0: np.ndarray, y1: np.ndarray, top: float, bottom: float) -> np.ndarray:
    shared = np.minimum(y1, bottom) - np.maximum(y0, top)
    return shared >= SAME_LINE * np.maximum(1.0, np.minimum(y1 - y0, bottom - top))


def _near_pairs(s: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of boxes in order of x0 that lie on one line with no wider gap; made by blocks of rows."""
    found = []
    for at in range(0, len(s), BLOCK):
        block = s[at : at + BLOCK]
        upto = np.searchsorted(s[:, 0], block[:, 2].max() + gap, "right")
        other = s[at:upto]
        # the one that begins later stands behind, so the gap is counted from the first's end
        near = (other[None, :, 0] - block[:, None, 2] <= gap) & _same_line(block[:, None, 1], block[:, None, 3], other[None, :, 1], other[None, :, 3])
        i, j = np.nonzero(np.triu(near))
        found.append((i + at, j + at))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def components(sides: np.ndarray, gap: float) -> np.ndarray:
    """Envelopes of the connected boxes (rows x0, y0, x1, y1): same line and no wider gap than this."""
    s = sides[np.lexsort(sides.T[::-1])]
    i, j = _near_pairs(s, gap)
    label = np.arange(len(s))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.diff(label[order], prepend=-1))
    out = np.hstack([np.minimum.reduceat(s[order, :2], first), np.maximum.reduceat(s[order, 2:], first)])
    return out[np.lexsort((out[:, 0], out[:, 1]))]


def absorb(sides: np.ndarray, gap: float) -> np.ndarray:
    """Boxes from the top left, each merged into the first grown box it is near, again until none merges."""
    while True:
        grown = np.empty((0, 4))
        for b in sides[np.lexsort((sides[:, 0], sides[:, 1]))]:
            apart = np.maximum(b[0] - grown[:, 2], grown[:, 0] - b[2])
            near = np.flatnonzero(_same_line(grown[:, 1], grown[:, 3], b[1], b[3]) & (apart <= gap))
            if len(near):
                g = grown[near[0]]
                grown[near[0]] = [*np.minimum(g[:2], b[:2]), *np.maximum(g[2:], b[2:])]
            else:
                grown = np.vstack([grown, b])
        if len(grown) == len(sides):
            return grown
        sides = grown


def merged(boxes: DataFrame, gap: float, many: int = MANY_BOXES) -> DataFrame:
    """Boxes of each page merged along lines; pages with more than ``many`` boxes by components."""

    def page(frame: pd.DataFrame) -> pd.DataFrame:
        sides = frame[["x0", "y0", "x1", "y1"]].to_numpy(float)
        out = components(sides, gap) if len(sides) > many else absorb(sides, gap)
        done = pd.DataFrame(out, columns=["x0", "y0", "x1", "y1"])
        done.insert(0, "page", frame["page"].iloc[0])
        return done

    return boxes.select("page", "x0", "y0", "x1", "y1").groupBy("page").applyInPandas(page, _MERGED)


def coarse_pruned(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Without boxes like whole paragraphs: tall against the page's upper median of heights."""
    order = Window.partitionBy("page").orderBy("_h", "pos")
    sized = boxes.withColumns({"_h": F.col("y1") - F.col("y0"), "_w": F.col("x1") - F.col("x0")})
    ranked = sized.withColumns({"_at": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy("page"))})
    median = F.max(F.when(F.col("_at") == F.floor(F.col("_n") / 2) + 1, F.col("_h"))).over(Window.partitionBy("page"))
    known = ranked.withColumn("_m", median)
    tall = (F.col("_h") >= F.greatest(F.col("_m") * 3.0, F.lit(0.14 * height))) & (F.col("_w") >= 0.2 * width)
    wide = (F.col("_w") >= 0.9 * width) & (F.col("_h") >= F.greatest(F.col("_m") * 1.8, F.lit(0.08 * height)))
    return known.where(~(tall | wide)).drop("_h", "_w", "_at", "_n", "_m")


def split_rows(boxes: DataFrame, parts: Column) -> DataFrame:
    """Each box as ``parts`` rows of equal height, ``line`` from 0."""
    cut = boxes.withColumn("_n", parts).withColumn("line", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    height = F.col("y1") - F.col("y0")
    return cut.withColumns({"top": F.col("y0") + height * F.col("line") / F.col("_n"), "bottom": F.col("y0") + height * (F.col("line") + 1) / F.col("_n")}).drop("_n")

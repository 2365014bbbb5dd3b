"""Operators that judge recognised pages and candidate payloads by statistics of their items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import spaced


def true_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The middle value, or the mean of the two middle ones."""
    return rows.groupBy(by).agg(F.median(value).alias("median"))


def _upper_median(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    ordered = Window.partitionBy(by).orderBy(value)
    placed = rows.select(by, F.col(value), F.row_number().over(ordered).alias("at"), F.count("*").over(Window.partitionBy(by)).alias("n"))
    return placed.where(F.col("at") == F.floor(F.col("n") / 2) + 1).select(by, F.col(value).alias(name))


def fragmented(boxes: DataFrame, width: int, least: int = 140, share: float = 0.18, heights: float = 2.9) -> DataFrame:
    """Pages with so many boxes that are narrow by their upper median: by the page's width, or by their height."""
    sized = boxes.select("page", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h")).where("w > 0 and h > 0")
    medians = _upper_median(sized, "page", "w", "width").join(_upper_median(sized, "page", "h", "height"), "page")
    counted = sized.groupBy("page").agg(F.count("*").alias("n")).join(medians, "page")
    return counted.where((F.col("n") >= least) & (F.col("width") <= F.greatest(F.lit(share * width), heights * F.col("height")))).select("page", "n", "width", "height")


def sparse_layout(items: DataFrame, width: int, height: int) -> DataFrame:
    """Wide pages of 4 to 18 items that are nearly all large and on the left, so that small text is likely missing.

    ``items`` has page, a box and ``length``, the characters of its text without white space; items without text or area do not count.
    """
    if width < 1.18 * height:
        return items.select("page").limit(0).selectExpr("page", "0L AS items", "0L AS large", "0L AS small", "0L AS right")
    valid = items.where("length > 0 and x1 > x0 and y1 > y0").select("page", F.greatest(F.lit(1), F.col("x1") - F.col("x0")).alias("w"), F.greatest(F.lit(1), F.col("y1") - F.col("y0")).alias("h"), (F.col("x0") + F.col("x1")).alias("twice"), "length")
    median = _upper_median(valid, "page", "h", "median").withColumn("median", F.greatest(F.lit(8.0), F.col("median").cast("double")))
    large = (F.col("h") >= F.greatest(1.7 * F.col("median"), F.lit(0.075 * height))) | ((F.col("w") >= 0.22 * width) & (F.col("length") >= 20))
    small = (F.col("w") <= 0.18 * width) & (F.col("h") <= 0.08 * height) & (F.col("length") <= 24)
    right = F.col("twice") / 2.0 >= 0.58 * width
    counts = valid.join(median, "page").groupBy("page").agg(F.count("*").alias("items"), F.count_if(large).alias("large"), F.count_if(small).alias("small"), F.count_if(right).alias("right"))
    return counts.where((F.col("items").between(4, 18)) & (F.col("large") >= F.greatest(F.lit(4), F.col("items") - 2)) & (F.col("small") <= 1) & (F.col("right") <= 1))


def content_scores(items: DataFrame) -> DataFrame:
    """Of each candidate the usable items and their score: text counts most, fine lines more, images by their file.

    ``items`` has candidate, image (whether its kind is one), text, path and y0, y1 (null: no box).
    """
    length = F.length(F.trim(F.replace("text", F.lit("\n"), F.lit(""))))
    h = F.abs(F.col("y1") - F.col("y0"))
    by_length = F.when(length <= 100, 1).when(length >= 500, -2).when(length >= 240, -1).otherwise(0)
    by_height = F.when(h <= 30, 2).when(h <= 55, 1).when(h >= 110, -2).when(h >= 75, -1).otherwise(0)
    has_text = F.coalesce(F.col("text") != "", F.lit(False))
    points = F.when(~F.col("image") & has_text, 4 + by_length + by_height).when(F.col("image"), F.when(F.coalesce(F.col("path") != "", F.lit(False)), 3).otherwise(2)).otherwise(1)
    return items.where("y0 is not null and y1 is not null").groupBy("candidate").agg(F.count("*").alias("usable"), F.sum(points).cast("long").alias("score"))


def text_heights(items: DataFrame) -> DataFrame:
    """Of each candidate the upper median and the nearest-rank ninth decile of its text boxes' heights."""
    tall = items.where("not image and text <> '' and y0 is not null and y1 is not null").select("candidate", F.abs(F.col("y1") - F.col("y0")).cast("double").alias("h")).where("h > 0")
    placed = tall.select("candidate", "h", F.row_number().over(Window.partitionBy("candidate").orderBy("h")).alias("at"), F.count("*").over(Window.partitionBy("candidate")).alias("n"))
    middle, ninth = F.floor(F.col("n") / 2) + 1, F.bround((F.col("n") - 1) * 0.9) + 1
    return placed.groupBy("candidate").agg(F.max(F.when(F.col("at") == middle, F.col("h"))).alias("median"), F.max(F.when(F.col("at") == ninth, F.col("h"))).alias("p90"))


def prefer_layout(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """For pairs of a content and a layout candidate whether the layout's is better: by usable items and score, or nearly so with finer boxes."""
    known = content_scores(items).join(text_heights(items), "candidate", "left")

    def side(name: str) -> DataFrame:
        return known.select(F.col("candidate").alias(name), F.struct("usable", "score", "median", "p90").alias(f"{name}_stats"))

    joined = pairs.join(side("content"), "content", "left").join(side("layout"), "layout", "left")

    def figure(name: str, field: str) -> Column:
        return F.coalesce(F.col(f"{name}_stats.{field}"), F.lit(0))

    more = F.struct(figure("layout", "usable"), figure("layout", "score")) > F.struct(figure("content", "usable"), figure("content", "score"))
    close = (figure("content", "score") - figure("layout", "score") <= 8) & (figure("content", "usable") - figure("layout", "usable") <= 2)
    finer = F.lit(True)
    for field, share in (("median", 0.82), ("p90", 0.88)):
        finer = finer & (F.greatest(F.lit(1.0), F.col(f"layout_stats.{field}")) <= share * F.greatest(F.lit(1.0), F.col(f"content_stats.{field}")))
    measured = F.col("content_stats.median").isNotNull() & F.col("layout_stats.median").isNotNull()
    return joined.select("content", "layout", F.coalesce(more | (close & measured & finer), F.lit(False)).alias("prefers_layout"))


def needs_tables(elements: DataFrame) -> DataFrame:
    """Pages without a table or a text layer that have many recognised texts, or very many texts.

    ``elements`` has page, type, source and has_text_layer (null: not known).
    """
    text = F.col("type") == "text"
    counts = elements.groupBy("page").agg(F.count_if(text).alias("texts"), F.count_if(text & (F.col("source") == "ocr")).alias("recognised"), F.max((F.col("type") == "table").cast("int")).alias("tables"), F.max(F.coalesce("has_text_layer", F.lit(False)).cast("int")).alias("layer"))
    return counts.where("tables = 0 and layer = 0 and (recognised >= 12 or texts >= 30)").select("page", "texts", "recognised")


def _is_whole(value: Column) -> Column:
    return F.schema_of_variant(value) == "BIGINT"


def _is_number(value: Column) -> Column:
    return F.regexp_like(F.schema_of_variant(value), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))


def reading_order(order: Column, n: Column) -> Column:
    """The order from JSON text: a list of different whole numbers from 0 to n - 1, not all of them needed; null for anything else."""
    parts = F.try_variant_get(F.try_parse_json(order), "$", "array<variant>")
    values = F.transform(parts, lambda v: F.try_variant_get(v, "$", "bigint"))
    good = F.forall(parts, _is_whole) & F.forall(values, lambda v: (v >= 0) & (v < n)) & (F.size(F.array_distinct(values)) == F.size(values))
    return F.when(good, values)


def table_grids(rows: DataFrame, grids: str) -> DataFrame:
    """id, pos, bbox, rows and cols of the grids of a JSON list that have four numbers and whole counts over 0."""
    parts = F.try_variant_get(F.try_parse_json(F.col(grids)), "$", "array<variant>")
    each = rows.select("id", F.posexplode(parts).alias("pos", "grid"))
    sides = F.try_variant_get("grid", "$.bbox", "array<variant>")
    count = {c: F.try_variant_get("grid", f"$.{c}", "variant") for c in ("rows", "cols")}
    number = {c: F.try_variant_get("grid", f"$.{c}", "bigint") for c in ("rows", "cols")}
    good = (F.size(sides) == 4) & F.forall(sides, _is_number) & _is_whole(count["rows"]) & _is_whole(count["cols"]) & (number["rows"] > 0) & (number["cols"] > 0)
    return each.where(good).select("id", "pos", F.transform(sides, lambda v: F.try_variant_get(v, "$", "double")).alias("bbox"), number["rows"].alias("rows"), number["cols"].alias("cols"))


def recognised_words(pages: DataFrame, least: float) -> DataFrame:
    """Words of pages whose columns are lists of one length: confident, not blank, with box and confidence of 0 to 1.

    ``pages`` has page, text, conf, left, top, width, height, block, par and line; pos is the place in the lists.
    """
    names = ("text", "conf", "left", "top", "width", "height", "block", "par", "line")
    each = pages.select("page", F.posexplode(F.arrays_zip(*names)).alias("pos", "w"))
    text, conf = F.trim("w.text"), F.coalesce(F.col("w.conf").try_cast("double"), F.lit(-1.0))
    kept = each.where((conf >= least) & (text != ""))
    return kept.select("page", "pos", text.alias("text"), (conf / 100.0).alias("confidence"), F.col("w.left").alias("x0"), F.col("w.top").alias("y0"), (F.col("w.left") + F.col("w.width")).alias("x1"), (F.col("w.top") + F.col("w.height")).alias("y1"), "w.block", "w.par", "w.line")


def word_stats(words: DataFrame, *by: str) -> DataFrame:
    """Words, structural lines and the mean confidence in percent."""
    return words.groupBy(*by).agg(F.count("*").alias("words"), F.count_distinct(F.struct("block", "par", "line")).alias("lines"), F.avg(F.col("confidence") * 100.0).alias("confidence"))


def best_pass(stats: DataFrame) -> DataFrame:
    """Of each page the pass with the most of ten for a line and one for a word, the first of equals.

    ``stats`` has page, pass, words and lines.
    """
    score = 10 * F.col("lines") + F.col("words")
    top = stats.groupBy("page").agg(F.max(F.struct(score.alias("score"), (-F.col("pass")).alias("back"))).alias("top"))
    return top.select("page", (-F.col("top.back")).alias("pass"), F.col("top.score").alias("score"))


def structural_lines(words: DataFrame) -> DataFrame:
    """Words by block, par and line of a page; lines are numbered in the order in which they are first seen."""
    lines = words.groupBy("page", "block", "par", "line").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return lines.select("page", "block", "par", "line", "n", F.row_number().over(Window.partitionBy("page").orderBy("first")).cast("long").alias("number"))


def char_frequencies(texts: DataFrame, key: str) -> DataFrame:
    """Different characters of a text, white space aside, and how often the most frequent one occurs."""
    each = texts.select(key, F.explode(F.split("text", "")).alias("c")).where(F.col("c").rlike(spaced(r"\S")))
    return each.groupBy(key, "c").agg(F.count("*").alias("n")).groupBy(key).agg(F.count("*").alias("different"), F.max("n").alias("most"))


def text_colours(samples: DataFrame, ground: str, most: int = 24) -> DataFrame:
    """The samples that tell a text's colour: of many the top quarter by contrast and distance, then those clearly off
    the ground's brightness if there are some, from the farthest.

    ``samples`` has page, pos, contrast, distance, luma and the ground's luma.
    """
    order = Window.partitionBy("page").orderBy(F.desc("contrast"), F.desc("distance"), "pos")
    placed = samples.withColumns({"at": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("page"))})
    keep = F.when(F.col("n") >= 12, F.greatest(F.lit(6), F.least(F.lit(96), F.floor(F.col("n") / 4)))).otherwise(F.col("n"))
    top = placed.where(F.col("at") <= keep)
    bright = F.col(ground) >= 128
    off = F.when(bright, F.col("luma") <= F.col(ground) - 6).otherwise(F.col("luma") >= F.col(ground) + 6)
    marked = top.withColumn("off", off).withColumn("any_off", F.max(F.col("off").cast("int")).over(Window.partitionBy("page")))
    chosen = marked.where(F.col("off") | (F.col("any_off") == 0))
    signed = F.when(bright, F.col("luma")).otherwise(-F.col("luma"))
    rank = F.row_number().over(Window.partitionBy("page").orderBy(signed, "at"))
    return chosen.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("page", "pos", "rank")

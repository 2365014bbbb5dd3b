"""Operators on recognised lines: a page's boxes with their text and confidence (0 to 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import kinds
from ..functions import text as txt

#: Short words that stand alone on slides and are no noise.
ACRONYMS = ("AI", "API", "LLM", "RAG", "NLP", "OCR", "PDF", "PPT", "PPTX", "GPT", "CPU", "GPU", "HTTP", "HTTPS", "JSON", "SQL", "UI", "UX", "SDK", "IDE", "ETL")
#: A Latin token of one, two small, two capital, and three or four capital letters is noise
#: below the first share of the page's area and from the second share of its height.
SHORT_LATIN = ((0.002, 0.08), (0.0012, 0.08), (0.0007, 0.10), (0.0009, 0.11))

LETTER, DIGIT = r"\p{L}", r"\p{Nd}"


def _packed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), txt.spaced(r"\s"), "")


def _capital(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def noise_line(text: Column, width: Column, height: Column, page_width: int, page_height: int) -> Column:
    """Whether a line is blank, an echoed prompt, without letters and digits, or a Latin token of up to
    four letters whose box is too small or too high for it. Null is blank."""
    packed = _packed(text)
    n = F.length(packed)
    share = F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height) / float(max(1, page_width * page_height))
    tall = F.greatest(F.lit(0.0), height) / float(page_height)
    latin = F.regexp_like(packed, F.lit(LETTER)) & ~F.regexp_like(packed, F.lit(DIGIT)) & ~txt.has_cjk(packed)
    known = F.upper(F.regexp_replace(packed, r"[^\p{L}]", "")).isin(*ACRONYMS)
    one, two, capitals, more = ((share < area) | (tall >= high) for area, high in SHORT_LATIN)
    short = F.when(n == 1, one).when(n == 2, F.when(_capital(packed), capitals).otherwise(two)).when(n.between(3, 4) & _capital(packed), more).otherwise(False)
    return (n == 0) | txt.prompt_echo(text) | ~F.regexp_like(packed, F.lit(r"[\p{L}\p{N}]")) | (latin & ~known & short)


def normalised(lines: DataFrame, page_width: int, page_height: int) -> DataFrame:
    """Lines that are no noise, trimmed and clamped to the page, with their ``rank`` in reading order; empty boxes go."""
    kept = lines.where(~noise_line(F.col("text"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), page_width, page_height) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    most = {"x0": page_width - 1, "y0": page_height - 1, "x1": page_width, "y1": page_height}
    inside = kept.withColumns({"text": txt.clean(F.col("text"))} | {n: geo.clamp(F.col(n).cast("double"), 0.0, float(m)) for n, m in most.items()})
    order = Window.partitionBy("page").orderBy(F.col("y0") + F.col("y1"), "x0", "pos")
    return inside.where("x1 > x0 and y1 > y0").withColumn("rank", F.row_number().over(order).cast("long"))


def in_context(lines: DataFrame, page_width: int, page_height: int) -> DataFrame:
    """Lines without those that are noise on their page.

    A page is CJK if these are 0.32 or more of its characters; there, small Latin and
    numeric fragments, mixed fragments and repeated marks go. On every page small
    short lines without CJK and with a confidence above 0 and below 0.45 go.
    """
    packed = _packed(F.col("text"))
    page = Window.partitionBy("page")
    counted = lines.withColumns({"_p": packed, "_cjk": F.regexp_count(packed, F.lit(txt.CJK))}).where("_p <> ''")
    counted = counted.withColumn("_on_cjk", F.sum("_cjk").over(page) >= 0.32 * F.sum(F.length("_p")).over(page))
    p, n = F.col("_p"), F.length("_p")
    letters = F.regexp_replace(p, r"[^\p{L}]", "")
    alpha, digit, cjk = F.length(letters), F.regexp_like(p, F.lit(DIGIT)), F.col("_cjk") > 0
    share = F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")) / float(page_width * page_height)
    small = (F.lower(letters) == letters) & (F.upper(letters) != letters)
    words = ((alpha <= 4) & ~F.upper(letters).isin(*ACRONYMS) & (share < 0.012)) | ((alpha <= 6) & small & (share < 0.015)) | (~cjk & (alpha >= 7) & (share < 0.0035)) | (cjk & (n <= 7) & (alpha <= 4))
    repeated = (alpha == 0) & cjk & (n <= 4) & F.regexp_like(p, F.lit(r"(.).*\1.*\1"))
    mixed = (alpha > 0) & digit & ~cjk & (n <= 14) & (share < 0.004)
    figures = (alpha == 0) & digit & ~cjk & (n <= 5) & (share < 0.0015)
    unsure = F.coalesce(~cjk & (n <= 8) & (F.col("confidence") > 0) & (F.col("confidence") < 0.45) & (share < 0.02), F.lit(False))
    gone = (F.col("_on_cjk") & (((alpha > 0) & ~digit & words) | repeated | mixed | figures)) | unsure
    return counted.where(~gone).drop("_p", "_cjk", "_on_cjk")


def spans_lines(text: Column, width: Column, height: Column, page_width: int, page_height: int, median: Column) -> Column:
    """Whether a box seems to hold several lines, against the median height of a line (2% of the page where it is 0)."""
    w, h = F.greatest(F.lit(1.0), width), F.greatest(F.lit(1.0), height)
    line = F.when(median > 0, median).otherwise(max(10.0, 0.02 * page_height))
    n = txt.compact_length(F.coalesce(text, F.lit("")))
    banner = (w >= 0.28 * page_width) & (h / w <= 0.11) & (n <= 42) & (h <= F.greatest(line * 3.6, F.lit(0.16 * page_height)))
    high = h >= F.greatest(line * 1.8, F.lit(0.055 * page_height))
    wide = (h >= F.greatest(line * 1.45, F.lit(0.045 * page_height))) & ((n >= 16) | (w >= 0.30 * page_width))
    return F.coalesce((F.contains(text, F.lit("\n")) & (n >= 3)) | ((n >= 8) & ~banner & (high | wide)), F.lit(False))


def wide_flat_pages(blocks: DataFrame, page_width: int, page_height: int) -> DataFrame:
    """Pages with one to three blocks of text, all wide and flat and near each other, one of them very wide."""
    own = blocks.where(~kinds.image_label(F.col("label")) & ~kinds.skipped_block(F.col("label")))
    w, h = F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")), F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    flat = (w / h >= 7.0) & (w / page_width >= 0.35) & (h / page_height <= 0.18)
    span = (F.max("y1") - F.min("y0")) / page_height <= 0.28
    page = own.groupBy("page").agg((F.count("*") <= 3).alias("few"), F.min(flat).alias("flat"), span.alias("near"), (F.max(w) / page_width >= 0.65).alias("wide"))
    return page.where("few and flat and near and wide").select("page")


def fragments(regions: DataFrame, lines: DataFrame, page_width: int, page_height: int, line_height: float) -> DataFrame:
    """Small regions that a line of text of four or more characters explains: it covers them, or shares their
    height and some of their width and is wider."""
    r, t = regions.alias("r"), lines.where((txt.compact_length(F.col("text")) >= 4) & (F.greatest(F.lit(1), F.col("y1") - F.col("y0")) >= max(4.0, 0.55 * line_height))).alias("t")
    area = F.greatest(F.lit(1.0), geo.area("r"))
    width, other = (F.greatest(F.lit(1), F.col(f"{b}.x1") - F.col(f"{b}.x0")) for b in "rt")
    height = F.greatest(F.lit(1), F.least(F.col("r.y1") - F.col("r.y0"), F.col("t.y1") - F.col("t.y0")))
    across = F.least("r.x1", "t.x1") - F.greatest("r.x0", "t.x0")
    down = F.least("r.y1", "t.y1") - F.greatest("r.y0", "t.y0")
    covered = geo.overlap("r", "t") / area
    beside = (down / height >= 0.68) & (across / F.least(width, other) >= 0.10) & ((other >= 1.1 * width) | (covered >= 0.55))
    return r.where(area / float(page_width * page_height) <= 0.015).join(t, (F.col("r.page") == F.col("t.page")) & geo.meets("r", "t") & ((covered >= 0.72) | beside), "left_semi")


def distinct_boxes(boxes: DataFrame, within: float = 2.0) -> DataFrame:
    """A page's boxes in order of pos, without those whose four sides are all this near to a kept one's.

    What goes depends on what is kept before, so a page is one fold over its boxes.
    """
    page = boxes.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("pos", "x0", "y0", "x1", "y1"))).alias("s"))

    def apart(b: Column, k: Column) -> Column:
        return F.greatest(*(F.abs(b[n] - k[n]) for n in ("x0", "y0", "x1", "y1"))) > within

    kept = F.aggregate("s", F.slice("s", 1, 0), lambda acc, b: F.when(F.forall(acc, lambda k: apart(b, k)), F.concat(acc, F.array(b))).otherwise(acc))
    return page.select("page", F.explode(kept).alias("k")).select("page", "k.pos", "k.x0", "k.y0", "k.x1", "k.y1")


def card_regions(regions: DataFrame, lines: DataFrame, page_width: float, page_height: float, line_height: float) -> DataFrame:
    """Regions of a card's size that hold texts: four, three with two in CJK, or two on a twentieth of a larger card.

    A text counts with its centre inside, no short token and not much lower than a line.
    """
    w, h = F.col("r.x1") - F.col("r.x0"), F.col("r.y1") - F.col("r.y0")
    share = w * h / max(1.0, page_width * page_height)
    sized = (share >= 0.10) & (w / page_width).between(0.22, 0.78) & (h / page_height).between(0.18, 0.78)
    counted = lines.where((F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")) >= max(4.0, 0.6 * line_height)) & ~txt.short_token(F.col("text")))
    hit = (F.col("r.page") == F.col("b.page")) & geo.centre_in("b", "r")
    found = regions.alias("r").where(sized).join(counted.alias("b"), hit)
    grouped = found.groupBy(F.col("r.page").alias("page"), F.col("r.region").alias("region"), share.alias("share"), (w * h).alias("whole"))
    held = grouped.agg(F.count("*").alias("n"), F.count_if(txt.has_cjk(F.col("b.text"))).alias("cjk"), F.sum(geo.overlap("r", "b")).alias("inter"))
    covered = F.least(F.lit(1.0), F.col("inter") / F.greatest(F.lit(1.0), "whole"))
    return held.where((F.col("n") >= 4) | ((F.col("cjk") >= 2) & (F.col("n") >= 3)) | ((F.col("n") >= 2) & (covered >= 0.05) & (F.col("share") >= 0.14))).select("page", "region", "n", "cjk")

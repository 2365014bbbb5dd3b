"""Operators on nested page records, on states of jobs and on results of several providers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as txt
from ..functions.geometry import hex_colour
from .events import in_time

#: Bits of a span's flags.
BOLD, ITALIC = 16, 2


def text_lines(pages: DataFrame) -> DataFrame:
    """A row for each line of the text blocks (type 0) that is not blank: its spans' text, the style of the span with
    the most characters, white space at the ends aside, the first of equals, and the line's box, else the block's.

    ``pages`` has page and blocks, an array of type, bbox and lines of bbox and spans of text, size, font, color, flags.
    """
    blocks = pages.select("page", F.posexplode("blocks").alias("block", "b")).where("b.type = 0")
    lines = blocks.select("page", "block", "b.bbox", F.posexplode("b.lines").alias("line", "l"))
    spans = F.col("l.spans")
    whole = F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), "")
    ranked = F.transform(spans, lambda s, i: F.struct(F.coalesce(F.length(txt.clean(s["text"])), F.lit(0)).alias("n"), (-i).alias("back"), s.alias("span")))
    style = F.array_max(ranked)["span"]
    out = lines.select("page", "block", "line", F.coalesce("l.bbox", "bbox").alias("bbox"), whole.alias("text"), style.alias("style")).where(txt.clean(F.col("text")).isNotNull())
    flags = F.coalesce("style.flags", F.lit(0))
    return out.select("page", "block", "line", "bbox", "text", F.coalesce("style.size", F.lit(0.0)).alias("size"), F.coalesce("style.font", F.lit("")).alias("font"), hex_colour(F.coalesce("style.color", F.lit(0))).alias("colour"), (flags.bitwiseAND(BOLD) != 0).alias("bold"), (flags.bitwiseAND(ITALIC) != 0).alias("italic"))


def table_cells(tables: DataFrame) -> DataFrame:
    """All cells of each table, row by row: a missing text is empty, a missing box is all zeros.

    ``tables`` has table, rows, cols, texts (rows of texts) and boxes (one list of four for each cell).
    """
    place = F.explode(F.sequence(F.lit(0), (F.col("rows") * F.col("cols") - 1).cast("int")))
    cells = tables.where("rows > 0 and cols > 0").select("table", "cols", "texts", "boxes", place.alias("i"))
    r, c = F.floor(F.col("i") / F.col("cols")).cast("int"), (F.col("i") % F.col("cols")).cast("int")
    text = F.try_element_at(F.try_element_at("texts", r + 1), c + 1)
    nothing = F.array(*[F.lit(0.0)] * 4)
    return cells.select("table", r.alias("r"), c.alias("c"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(F.try_element_at("boxes", F.col("i") + 1), nothing).alias("bbox"))


def job_states(updates: DataFrame, terminal: Sequence[str]) -> DataFrame:
    """``applied``, and the job's state after each update: the last status and progress that were given.

    Once a job has ended, only updates that name its own status apply. ``reported`` is
    the progress that is shown while it runs: within 0 to 99, and never less than before.
    """
    before = in_time().rowsBetween(Window.unboundedPreceding, -1)
    upto = in_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.first(F.when(F.col("status").isin(*terminal), F.col("status")), ignorenulls=True).over(before)
    marked = updates.withColumn("_ended", ended).withColumn("applied", F.col("_ended").isNull() | F.coalesce(F.col("status") == F.col("_ended"), F.lit(False)))

    def last(name: str) -> Column:
        return F.last(F.when(F.col("applied"), F.col(name)), ignorenulls=True).over(upto)

    shown = F.max(F.when(F.col("applied"), F.least(F.greatest(F.col("progress"), F.lit(0)), F.lit(99)))).over(upto)
    return marked.select("job", "event_id", "applied", last("status").alias("status"), last("progress").alias("progress"), shown.alias("reported"))


def ttl_reads(events: DataFrame, seconds: int) -> DataFrame:
    """What each read of a key finds: the value last written before it, if its time is not over.

    ``events`` has job (the key), ts, event_id and value, null for a read.
    """
    upto = in_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    wrote = events.withColumns({"_at": at, "_last": F.last(F.when(F.col("value").isNotNull(), F.struct(at.alias("at"), "value")), ignorenulls=True).over(upto)})
    alive = F.col("_last.at") + seconds * 1_000_000 > F.col("_at")
    return wrote.where("value is null").select("job", "event_id", F.when(alive, F.col("_last.value")).alias("found"))


def first_available(results: DataFrame, ranking: Sequence[str]) -> DataFrame:
    """Of each page the first provider in order that found something, and how much; null where none did."""
    rank = F.array_position(F.array(*[F.lit(p) for p in ranking]), F.col("provider"))
    useful = (F.col("found") > 0) & (rank > 0)
    best = results.groupBy("page").agg(F.min(F.when(useful, F.struct(rank.alias("rank"), "provider", "found"))).alias("best"))
    return best.select("page", "best.provider", "best.found")


def merged_segments(words: DataFrame, *by: str) -> DataFrame:
    """Words of a segment in order of x0 as one line: texts joined with a blank where two tokens need one, the hull, and the mean confidence."""
    order = Window.partitionBy(*by).orderBy("x0", "pos")
    before = F.lag("text").over(order)
    piece = F.concat(F.when(F.coalesce(txt.needs_space(before, F.col("text")), F.lit(False)), " ").otherwise(""), F.col("text"))
    pieces = words.withColumn("_piece", piece)
    out = pieces.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("x0", "pos", "_piece"))).alias("_p"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("confidence").alias("confidence"))
    return out.select(*by, F.array_join(F.col("_p._piece"), "").alias("text"), "x0", "y0", "x1", "y1", "confidence")


def block_progress(blocks: DataFrame, by: str, done: str, failed: str, most: int = 12) -> DataFrame:
    """Counts of blocks by state, and the first unfinished ones in order of id."""
    ended = F.col("status").isin(done, failed)
    out = blocks.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("status") == done).alias("success"), F.count_if(F.col("status") == failed).alias("error"), F.count_if(~ended).alias("pending"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("id"))
    first = blocks.where(~ended).withColumn("_at", place).where(F.col("_at") <= most).groupBy(by).agg(F.sort_array(F.collect_list("id")).alias("unfinished"))
    return out.join(first, by, "left").withColumn("unfinished", F.coalesce("unfinished", F.array().cast("array<bigint>")))


def _counts(entries: DataFrame, by: str, name: str, out: str) -> DataFrame:
    value = txt.clean(F.col(name))
    counted = entries.where(value.isNotNull()).groupBy(by, value.alias("_value")).agg(F.count("*").alias("_n"))
    return counted.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_value", "_n")))).alias(out))


def runtime_summary(entries: DataFrame, by: str) -> DataFrame:
    """Pages with elements, with errors and with fallbacks, and maps of providers and of reasons to their counts.

    ``entries`` has provider, reason, elements and failed (whether the page had an error or a warning).
    """
    out = entries.groupBy(by).agg(F.count_if(F.col("elements") > 0).alias("with_elements"), F.count_if("failed").alias("with_errors"), F.count_if(txt.clean(F.col("reason")).isNotNull()).alias("fallbacks"))
    none = F.create_map().cast("map<string,bigint>")
    for name, column in (("provider", "providers"), ("reason", "reasons")):
        out = out.join(_counts(entries, by, name, column), by, "left").withColumn(column, F.coalesce(column, none))
    return out.withColumn("distinct_providers", F.size("providers").cast("long"))


def filled_pages(items: DataFrame, sizes: DataFrame, shift: int, start: int, end: int, width: float, height: float) -> DataFrame:
    """The pages start to end of each document with the number of their items, shifted, and their size, else the default.

    ``items`` has doc and page, ``sizes`` doc, page, width and height.
    """
    moved = items.select("doc", (F.col("page") + shift).alias("page")).where("page >= 0")
    counts = moved.groupBy("doc", "page").agg(F.count("*").alias("n"))
    wanted = items.select("doc").distinct().select("doc", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end).cast("long"))).alias("page"))
    joined = wanted.join(counts, ["doc", "page"], "left").join(sizes, ["doc", "page"], "left")
    return joined.select("doc", "page", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("width").cast("double"), F.lit(width)).alias("width"), F.coalesce(F.col("height").cast("double"), F.lit(height)).alias("height"))


def split_lines(boxes: DataFrame, splits: DataFrame) -> DataFrame:
    """Boxes with a split of several lines as a row for each line, its height in equal parts; the others as they are.

    ``splits`` has page, pos and lines; ``line`` counts from 0.
    """
    joined = boxes.join(splits, ["page", "pos"], "left")
    lines = F.when(F.size("lines") > 1, F.col("lines")).otherwise(F.array("text"))
    each = joined.withColumn("_n", F.size(lines)).select("page", "pos", "y0", "y1", "_n", F.posexplode(lines).alias("line", "text"))
    height = F.col("y1") - F.col("y0")
    return each.select("page", "pos", F.col("line").cast("long").alias("line"), "text", (F.col("y0") + height * F.col("line") / F.col("_n")).alias("top"), (F.col("y0") + height * (F.col("line") + 1) / F.col("_n")).alias("bottom"))

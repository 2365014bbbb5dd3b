"""Fuzzy line dedup, in DataFrame operations alone.

A line is the set of its character shingles, all of which are signed. Each shingle is
hashed to 128 bits, which give BANDS / 2 orders of the shingles; a signature is the
smallest and the largest value of each order. A band is ROWS of these, and each serves
ROWS bands. Lines that share a band are candidates. Pairs whose sizes and parity words
show that they cannot link are left out, the others are verified by the Jaccard
similarity of their whole shingle sets. Verified links are joined by union-find, and of
each component the first line in order of document stays.

Shingles of a line are hashed GROUP at a time, in one row; its last row repeats the last
shingle, which changes no minimum and no set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import SMALL, link_buckets, list_parities, may_link
from .names import fresh
from .scratch import Scratch

#: Characters of a shingle; lines with fewer than MIN_CHARS characters have none and are compared for equality alone.
SHINGLE = 8
MIN_CHARS = SHINGLE
#: 100 times the similarity from which two lines are the same.
SIMILARITY = 80
#: Of pairs at the threshold one in 4800 shares no band.
BANDS, ROWS = 20, 3
#: The values of each band: a cyclic design, in which two bands share one value at most. Value i is the least of
#: order i or the largest of order i - BANDS / 2, which no band has both.
MEMBERS = [(i, (i + 1) % BANDS, (i + 4) % BANDS) for i in range(BANDS)]
#: An order goes by a hash without so many of its first bits; half of the orders go by either hash.
SKIPPED = (0, 10, 20, 30, 40)
#: Shingles that one row hashes.
GROUP = 8
#: The same where sets are gathered, a row at a time.
WIDE_GROUP = 16
#: Parts of the bands that are shuffled one after another.
SLICES = 4
#: Keys of candidate lines that are broadcast at most (some 30 MB) to pick their texts in place; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: A component with more than one in so many of the lines is hot; there are fewer of these than this.
HOT_SHARE = 1000


def _units(line: Column | str) -> Column:
    """Two bytes for each character, so a shingle is cut out in constant time."""
    return F.encode(line, "UTF-16BE")


def _lines(documents: DataFrame) -> DataFrame:
    """A row for each line that may be dropped: its document, number, hashes and text."""
    row = F.xxhash64("doc_id", "text").alias("row")
    split = documents.where(F.col("text").isNotNull()).select("doc_id", row, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.where(F.col("line").rlike(r"\S")).select("doc_id", "row", "line_no", F.xxhash64("line").alias("key"), F.xxhash64("line", F.lit(1)).alias("key2"), "line")


def _hashes(units: str, last: str, group: int) -> list[Column]:
    """The hashes of so many shingles from ``at`` on; beyond the last, of the last."""
    return [F.xxhash64(F.expr(f"substring({units}, least(at + {2 * j}, {last}), {2 * SHINGLE})")) for j in range(group)]


def _hashed(lines: DataFrame, group: int) -> DataFrame:
    """key and h0, h1, ..., the hashes of so many of the line's shingles, in as many rows as it takes."""
    units = lines.select("key", _units("line").alias("units")).select("key", "units", F.expr(f"octet_length(units) - {2 * SHINGLE - 1}").alias("last"))
    rows = units.select("key", "units", "last", F.explode(F.expr(f"sequence(1, last, {2 * group})")).alias("at"))
    return rows.select("key", *[h.alias(f"h{j}") for j, h in enumerate(_hashes("units", "last", group))])


def _bands(lines: DataFrame) -> DataFrame:
    """key and the hashes of its signature's bands. Equal lines meet in one row, most within their task."""
    hashed = _hashed(lines, GROUP)
    twice = hashed.select("key", *[F.col(f"h{j}").alias(f"x0{j}") for j in range(GROUP)], *[F.xxhash64(f"h{j}").alias(f"x1{j}") for j in range(GROUP)])
    orders = [[F.shiftleft(f"x{own}{j}", skipped) if skipped else F.col(f"x{own}{j}") for j in range(GROUP)] for own in (0, 1) for skipped in SKIPPED]
    ends = [F.min(F.least(*o)) for o in orders] + [F.max(F.greatest(*o)) for o in orders]
    signed = twice.groupBy("key").agg(*[end.alias(f"m{i}") for i, end in enumerate(ends)])
    return signed.select("key", F.array(*[F.xxhash64(F.lit(b), *[f"m{i}" for i in band]) for b, band in enumerate(MEMBERS)]).alias("bands"))


def _sets(lines: DataFrame) -> DataFrame:
    """key and s, all distinct shingle hashes of each line."""
    parts = _hashed(lines, WIDE_GROUP)
    parts = parts.select("key", F.array(*[f"h{j}" for j in range(WIDE_GROUP)]).alias("part"))
    return parts.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("part"))).alias("s"))


def _components(scratch: Scratch, lines: DataFrame) -> DataFrame:
    """id and label of the lines that are linked to an unequal one."""
    bands = scratch.keep("bands", _bands(lines.where(F.length("line") >= MIN_CHARS)))
    scratch.release()
    found, each = None, BANDS // SLICES
    for part in range(SLICES):
        rows = bands.select("key", F.explode(F.slice("bands", part * each + 1, each)).alias("bucket"))
        many = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).where("n > 1")
        many = scratch.keep(f"buckets{part}", many)
        found = many if found is None else found.union(many)
        scratch.release()
    first = found.where("n = 2").select("a", "b").distinct()
    wide = found.where("n > 2").select("bucket")
    if wide.count() <= BROADCAST_KEYS:
        wide = F.broadcast(wide)
    rows = bands.select("key", F.explode("bands").alias("bucket"))
    members = scratch.keep("large", rows.join(wide, "bucket", "left_semi").select("bucket", F.col("key").alias("id")))
    scratch.drop("bands")
    needed = scratch.keep("needed", first.select(F.explode(F.array("a", "b")).alias("key")).union(members.select("id")).distinct())
    picked = F.broadcast(needed) if needed.count() <= BROADCAST_KEYS else needed
    # equal lines meet before the shuffle where they stand in one task
    texts = scratch.keep_bucketed("texts", lines.select("key", "line").join(picked, "key", "left_semi").dropDuplicates(["key"]), "key")
    scratch.release()
    items = scratch.keep_bucketed("items", list_parities(_sets(texts), "key", "s", GROUP), "id")
    x, y = items.alias("x"), items.alias("y")
    first = scratch.keep("first", first.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id")).where(may_link(SIMILARITY, "x", "y")).select("a", "b"))
    scratch.drop(*[f"buckets{part}" for part in range(SLICES)])

    def verify(pairs: DataFrame, few: bool = False) -> DataFrame:
        ends = [texts.select(F.col("key").alias(end), _units("line").alias(f"u{end}"), F.expr(f"2 * length(line) - {2 * SHINGLE - 1}").alias(f"last{end}")) for end in ("a", "b")]
        # few pairs and their texts are broadcast, so that the table of texts is read and not sorted
        one = F.broadcast(F.broadcast(pairs.select("a", "b")).join(ends[0], "a")) if few else pairs.select("a", "b").join(ends[0], "a")
        both = one.join(ends[1], "b")
        # the sets of both sides from rows of WIDE_GROUP shingles: a lambda over the units would copy them for each shingle
        rows = both.select("a", "b", "ua", "ub", "lasta", "lastb", F.explode(F.expr(f"sequence(1, greatest(lasta, lastb), {2 * WIDE_GROUP})")).alias("at"))
        parts = rows.select("a", "b", *[F.array(*_hashes(f"u{end}", f"last{end}", WIDE_GROUP)).alias(f"s{end}") for end in ("a", "b")])
        sets = parts.groupBy("a", "b").agg(*[F.array_distinct(F.flatten(F.collect_list(f"s{end}"))).alias(f"s{end}") for end in ("a", "b")])
        # a generator, or the filter's copies of these expressions compute them several times
        sized = sets.select("a", "b", F.inline(F.array(F.struct((F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("shared")))))
        return sized.where(100 * F.col("shared") >= SIMILARITY * (F.col("total") - F.col("shared")))

    return link_buckets(scratch, first, members, items, SIMILARITY, verify, SMALL, lambda pairs: verify(pairs, few=True))


def dropped_lines(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """row (a hash of doc_id and text) and the numbers of its lines that go."""
    lines = _lines(documents)
    linked = _components(scratch, lines)
    labels = linked.select(F.col("id").alias("key"), "label")
    if linked.count() <= BROADCAST_KEYS:
        labels = F.broadcast(labels)
    seen = lines.select("doc_id", "row", "line_no", "key", "key2").join(labels, "key", "left")
    # a line without links is a component with its equals, told apart by both hashes
    seen = scratch.keep("seen", seen.select("doc_id", "row", "line_no", F.coalesce("label", "key").alias("c1"), F.when(F.col("label").isNull(), F.col("key2")).otherwise(0).alias("c2")))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row", "line_no")
    firsts = seen.groupBy("c1", "c2").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1")
    firsts = scratch.keep("firsts", firsts.select("c1", "c2", "times", F.col("first.row").alias("first_row"), F.col("first.line_no").alias("first_no")))
    scratch.release()
    # the hot components are few by their share of the lines: their lines are joined in place, the others' by a shuffle
    least = seen.count() // HOT_SHARE
    hot = F.broadcast(firsts.where(F.col("times") > least).select("c1", "c2", "first_row", "first_no", F.lit(True).alias("hot")))
    marked = seen.join(hot, ["c1", "c2"], "left")
    others = marked.where("hot is null").drop("hot", "first_row", "first_no").join(firsts.where(F.col("times") <= least).drop("times"), ["c1", "c2"])
    again = marked.where("hot").drop("hot").unionByName(others)
    gone = again.where((F.col("row") != F.col("first_row")) | (F.col("line_no") != F.col("first_no")))
    out = scratch.keep("gone", gone.groupBy("row").agg(F.sort_array(F.collect_set("line_no")).alias("dropped")))
    scratch.drop("seen", "firsts")
    scratch.release()
    return out


def line_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, dropped_lines (numbers from 0) and the text that is left of every document.

    Blank lines stay as they are; lines with less than MIN_CHARS characters go as exact
    copies alone.
    Of each component of equal or similar lines the first in order of doc_id (null
    last), a hash of the row and line number stays; rows with the same doc_id and text
    lose the same lines. Null text has no lines and stays null, empty text has one
    empty line, an empty table gives no rows. Other columns are not read.
    """
    marked, gone, left = _rewritten(documents.select("doc_id", "text"))
    return marked.select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"),
        F.coalesce(gone, F.array().cast("array<int>")).alias("dropped_lines"),
        left.alias("text"),
    )


def _rewritten(documents: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The documents with the numbers of the lines that go, null if none do, and the text that is left."""
    scratch = Scratch(documents.sparkSession, "lines")
    row, gone = fresh(documents, "row"), fresh(documents, "gone")
    dropped = dropped_lines(documents.select("doc_id", "text"), scratch).select(F.col("row").alias(row), F.col("dropped").alias(gone))
    joined = documents.withColumn(row, F.xxhash64("doc_id", "text")).join(dropped, row, "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col(gone), i)), "\n")
    return joined, F.col(gone), F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents with the lines that are left; other columns as they were, n_chars counted again if it is there.

    A document that loses lines and has no word left goes. An empty table stays empty.
    """
    marked, gone, left = _rewritten(documents)
    out = marked.where(gone.isNull() | (F.length(F.trim(left)) > 0))
    changed = {"text": left}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(gone.isNull(), F.col("n_chars")).otherwise(F.length(left).cast(documents.schema["n_chars"].dataType))
    return out.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in documents.columns])

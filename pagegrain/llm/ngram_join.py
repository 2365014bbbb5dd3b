"""Jaccard join of documents on word shingles by grouped prefixes.

All shingles are ordered: first the rare ones of the lowest quarter of the hash
space, then the rare ones above, then the frequent ones by hash. Two sets with a
similarity of t share a shingle of their prefixes, the first n - ceil(t n) + 1 in
this order. A shingle is frequent if more than MANY groups post it, so the lists of
rare shingles are short and are joined outright; documents made almost wholly of
frequent shingles have lists of any length, which are compared by centres and only
across components.

Documents with equal sets are one class. Sets too small to link with an unequal one
end there. Classes with the same size and the same shingles in the lowest quarter
(identical prefixes), one at least, are one group, which posts once.
Group pairs pass a size filter and a count filter, both without loss, and are then
expanded to their members, whose whole sets are verified. Shingles are told apart
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import Text, as_long, chunks, lists, mix, shingles
from .components import WORDS as PARITY
from .components import link_buckets, may_link
from .names import fresh
from .scratch import Scratch

WORDS = 5
#: 100 times the similarity from which documents link.
SIMILARITY = 80
#: Groups that post a shingle before it counts as frequent.
MANY = 16
CELLS = 64 * PARITY
#: Rows of three longs that are broadcast at most (some 80 MB) to pick texts in place; more are joined by a shuffle of the texts.
BROADCAST_ROWS = 1_000_000
#: The least size of a set that can link with an unequal one; a set of n at best shares n of n + 1.
LINKABLE = next(n for n in range(1, 1000) if 100 * n >= SIMILARITY * (n + 1))
#: The part of the hash space that is posted first: a quarter.
LOW = np.uint64(1 << 62)


def _per_text(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums by text of 64-bit values that stand text by text."""
    sums = np.zeros(len(found) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(found, out=sums[1:], dtype=np.uint64)
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the number of shingles, two hashes of the set, a hash of its low shingles, and these."""
    for batch in batches:
        for part in chunks(batch, "text"):
            found, counts = shingles(Text(part.column("text")), WORDS)
            low = found < LOW
            own = np.repeat(np.arange(len(counts)), counts)
            few = np.bincount(own[low], minlength=len(counts))
            whole = _per_text(mix(found ^ np.uint64(1)), counts)
            # without a low shingle there is no prefix to share: such sets are groups of their own
            low_hash = np.where(few > 0, _per_text(mix(found[low] ^ np.uint64(3)), few), whole)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_hash"),
                    pa.array(counts.astype(np.int64)),
                    pa.array(as_long(whole)),
                    pa.array(as_long(_per_text(mix(found ^ np.uint64(2)), counts))),
                    pa.array(as_long(low_hash)),
                    lists(pa.array(as_long(found[low])), few),
                ],
                ["doc_id", "text_hash", "n", "set1", "set2", "low_hash", "low"],
            )


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            found, counts = shingles(Text(part.column("text")), WORDS)
            own = np.repeat(np.arange(len(counts)), counts)
            odd = np.bincount(own * CELLS + (found >> np.uint64(54)).astype(np.int64), minlength=len(counts) * CELLS) & 1
            words = np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little").view(np.int64).reshape(len(counts), PARITY)
            yield pa.RecordBatch.from_arrays([part.column("id"), lists(pa.array(as_long(found)), counts), *(pa.array(words[:, w]) for w in range(PARITY))], ["id", "s", *(f"g{w}" for w in range(PARITY))])


def _prefix(n: Column) -> Column:
    """n - ceil(t n) + 1."""
    return n - F.expr(f"({SIMILARITY}L * n + 99L) div 100L") + 1


def _shared_least(a: str, b: str) -> Column:
    """The least number of shared shingles of sets of these sizes that link."""
    return F.ceil((F.col(a) + F.col(b)) * F.lit(SIMILARITY) / F.lit(100.0 + SIMILARITY) - F.lit(1e-6))


def _counted(scratch: Scratch, posts: DataFrame, name: str) -> DataFrame:
    """The posts id, shingle of shingles that several ids post, and whether these are frequent."""
    often = posts.groupBy("shingle").agg(F.count("*").alias("groups")).where("groups > 1")
    known = scratch.keep(f"{name}-often", often.select("shingle", (F.col("groups") > MANY).alias("frequent")))
    scratch.release()
    out = scratch.keep(name, posts.join(known, "shingle").select("id", "shingle", "frequent"))
    scratch.release()
    return out


def _candidates(scratch: Scratch, posts: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """Pairs a < b that share enough rare shingles. ``sizes`` has id, n and rare, all rare posts of the id.

    A pair that links differs in at most n - shared_least shingles on either side, so
    it shares all other rare ones.
    """
    rare = scratch.keep(f"{name}-rare", posts.where(~F.col("frequent")).join(sizes, "id").select("id", "shingle", "n", "rare"))
    a = rare.select("shingle", F.col("id").alias("a"), F.col("n").alias("na"), F.col("rare").alias("ra"))
    b = rare.select("shingle", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("rare").alias("rb"))
    near = 100 * F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")
    shared = a.join(b, "shingle").where((F.col("a") < F.col("b")) & near).groupBy("a", "b", "na", "nb", "ra", "rb").agg(F.count("*").alias("shared"))
    least = _shared_least("na", "nb")
    enough = (F.col("shared") >= F.col("ra") - F.col("na") + least) & (F.col("shared") >= F.col("rb") - F.col("nb") + least)
    return scratch.keep(f"{name}-pairs", shared.where(enough).select("a", "b"))


def ngram_join(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id of every document.

    Every row is a document. ``class_id`` is the smallest doc_id with the same set,
    ``component_id`` the smallest in the component; null ids count only where there is
    no other. A document without words (null, empty or blank text) has an empty set,
    links with nothing and is its own component. Other columns are not read.
    """
    joined = _joined(documents, Scratch(documents.sparkSession, "ngrams"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")


def _joined(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash, n, label (of the component, null without words), component_id and class_id of every row."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    signed = texts.mapInArrow(_signed, "doc_id long, text_hash long, n long, set1 long, set2 long, low_hash long, low array<long>")
    signed = scratch.keep("signed", signed.withColumn("row", F.monotonically_increasing_id()))
    first_row = [F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.min_by("doc_id", "row").alias("row_doc"), F.min_by("text_hash", "row").alias("row_text"), F.first("low_hash").alias("low_hash")]
    classes = signed.where("n > 0").groupBy("n", "set1", "set2").agg(*first_row)
    # from here on an id is a class; it is written, so it stays the same
    classes = scratch.keep("classes", classes.withColumn("id", F.monotonically_increasing_id()))
    # smaller sets link with equal ones alone, and these are one class
    able = classes.where(F.col("n") >= LINKABLE)
    groups = scratch.keep("groups", able.groupBy("n", "low_hash").agg(F.min("id").alias("leader"), F.count("*").alias("members")))
    leaders = able.select("id", "row", "n").join(groups.select(F.col("leader").alias("id")), "id", "left_semi")
    posting = scratch.keep("posting", signed.select("row", "low").join(scratch.keep("leaders", leaders), "row").select("id", "n", "low"))
    scratch.release()

    # the lowest quarter, of all groups
    posts = _counted(scratch, posting.select("id", F.explode("low").alias("shingle")), "low")
    frequent = posts.where("frequent").groupBy("id").agg(F.count("*").alias("frequent"))
    sizes = posting.select("id", "n", F.size("low").alias("low")).join(frequent, "id", "left")
    sizes = scratch.keep("sizes", sizes.select("id", "n", (F.col("low") - F.coalesce("frequent", F.lit(0))).alias("rare")))
    pairs = _candidates(scratch, posts, sizes, "low")
    scratch.release()

    # everything above it, of the members of groups whose rare low shingles do not fill a prefix
    open_groups = scratch.keep("open", sizes.where(F.col("rare") < _prefix(F.col("n"))).select("id", "n", "rare"))
    member = able.join(groups, ["n", "low_hash"]).select("id", "leader", "n", "members")
    member = scratch.keep("member", member)
    wide = scratch.keep("wide", member.join(open_groups.select(F.col("id").alias("leader"), "rare"), "leader").select("id", "leader", "n", "rare"))
    large = member.where("members > 1")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("leader")).distinct()
    needed = member.select("id", "leader").join(ends, "leader", "left_semi").select("id").union(wide.select("id")).union(large.select("id")).distinct()
    needed = scratch.keep("needed", needed)
    wanted = scratch.keep("wanted", classes.join(needed, "id", "left_semi").select("id", "row_doc", "row_text"))
    picked = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    rows = texts.join(picked, F.col("doc_id").eqNullSafe(F.col("row_doc")) & (F.col("text_hash") == F.col("row_text")))
    # rows that repeat a doc_id and a text come more than once
    sets = rows.select("id", "text").mapInArrow(_whole, "id long, s array<long>, " + ", ".join(f"g{w} long" for w in range(PARITY)))
    # every round of linking joins the sets by id
    sets = scratch.keep_bucketed("sets", sets.dropDuplicates(["id"]), "id")
    scratch.release()

    bound = int(as_long(np.array([LOW]))[0])
    high = F.filter("s", lambda x: (x < 0) | (x >= bound))
    above = wide.join(sets, "id").select("id", "n", F.col("rare").alias("low_rare"), F.explode_outer(high).alias("shingle"))
    above_posts = _counted(scratch, above.where("shingle is not null").select("id", "shingle"), "high")
    above_frequent = above_posts.where("frequent").groupBy("id").agg(F.count("*").alias("frequent"))
    above_sizes = wide.join(sets, "id").select("id", "n", F.col("rare").alias("low_rare"), F.size(high).alias("high")).join(above_frequent, "id", "left")
    above_sizes = scratch.keep("above", above_sizes.select("id", "n", "low_rare", (F.col("high") - F.coalesce("frequent", F.lit(0))).alias("rare")))
    more = _candidates(scratch, above_posts, above_sizes.select("id", "n", "rare"), "high")

    # the frequent ones by hash, as many as the prefix lacks
    lacking = above_sizes.select("id", (_prefix(F.col("n")) - F.col("low_rare") - F.col("rare")).alias("lack")).where("lack > 0")
    lacking = scratch.keep("lacking", lacking)
    low_frequent = member.select("id", "leader").join(lacking, "id", "left_semi").join(posts.where("frequent").select(F.col("id").alias("leader"), "shingle"), "leader").select("id", "shingle")
    all_frequent = low_frequent.union(above_posts.where("frequent").join(lacking, "id", "left_semi").select("id", "shingle"))
    last = all_frequent.groupBy("id").agg(F.sort_array(F.collect_list("shingle")).alias("s")).join(lacking, "id")
    lists_ = last.select("id", F.explode(F.slice("s", F.lit(1), F.col("lack").cast("int"))).alias("shingle"))

    # buckets: groups, pairs of groups that are not both single, and the long lists
    alone = groups.where("members = 1").select(F.col("leader").alias("id"))
    grouped = pairs.join(alone.select(F.col("id").alias("a"), F.lit(True).alias("one")), "a", "left").join(alone.select(F.col("id").alias("b"), F.lit(True).alias("other")), "b", "left")
    grouped = scratch.keep("grouped", grouped.where("one is null or other is null").select("a", "b"))
    sides = grouped.select(F.concat_ws("/", F.lit("p"), "a", "b").alias("bucket"), F.explode(F.array("a", "b")).alias("leader"))
    buckets = large.select(F.concat_ws("/", F.lit("g"), "leader").alias("bucket"), "id")
    buckets = buckets.union(sides.join(member.select("id", "leader"), "leader").select("bucket", "id"))
    buckets = buckets.union(lists_.select(F.concat_ws("/", F.lit("s"), "shingle").alias("bucket"), "id"))

    items = sets.select("id", F.size("s").cast("long").alias("n"), *(f"g{w}" for w in range(PARITY)))

    def verify(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
        b = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
        sized = pairs.join(a, "a").join(b, "b").where(100 * F.least(F.size("sa"), F.size("sb")) >= SIMILARITY * F.greatest(F.size("sa"), F.size("sb")))
        # a generator between, or the filter's copy of the expression computes it again
        both = sized.select("a", "b", F.inline(F.array(F.struct(F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both")))))
        return both.where(100 * F.col("both") >= SIMILARITY * (F.col("na") + F.col("nb") - F.col("both")))

    x, y = items.alias("x"), items.alias("y")
    close = pairs.union(more).distinct().join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id")).where(may_link(SIMILARITY, "x", "y"))
    labels = link_buckets(scratch, close.select("a", "b"), buckets, items, SIMILARITY, verify)
    node = scratch.keep("labelled", classes.join(labels, "id", "left").select("n", "set1", "set2", "doc_id", F.coalesce("label", "id").alias("label")))
    lowest = scratch.keep("lowest", node.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    joined = scratch.keep("joined", node.join(lowest, "label").select("n", "set1", "set2", F.col("doc_id").alias("class_id"), "component_id", "label"))
    rows = signed.select("doc_id", "text_hash", "n", "set1", "set2")
    linked = rows.where("n > 0").join(joined, ["n", "set1", "set2"])
    empty = rows.where("n = 0").select("doc_id", "text_hash", "n", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return linked.select("doc_id", "text_hash", "n", "label", "component_id", "class_id").unionByName(empty)


def _rows_of(documents: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The documents that have (left_semi) or have not (left_anti) one of these doc_id, text_hash."""
    doc, text = fresh(documents, "doc"), fresh(documents, "text")
    named = rows.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text))
    return documents.join(named, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text)), how)


def representatives(documents: DataFrame) -> DataFrame:
    """The documents, all columns as they were, without those whose component has a smaller doc_id.

    A row is told by its doc_id and text. Documents without words and with null doc_id
    stay. Repeated rows of a doc_id that stays all stay.
    """
    joined = _joined(documents, Scratch(documents.sparkSession, "ngrams"))
    return _rows_of(documents, joined.where("component_id < doc_id").select("doc_id", "text_hash").distinct(), "left_anti")


def singles(documents: DataFrame) -> DataFrame:
    """The documents, all columns as they were, with exactly one row of each component.

    The first by doc_id (null last) and a hash of the text stays; of rows that repeat
    both, the smallest by all columns. Documents without words stay; an empty table
    stays empty.
    """
    scratch = Scratch(documents.sparkSession, "singles")
    joined = scratch.keep("joined", _joined(documents, scratch).where("n > 0").groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("times")))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")
    firsts = scratch.keep("firsts", joined.groupBy("label").agg(F.min(place).alias("first")).select("label", "first.doc_id", "first.text_hash"))
    same = F.col("j.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("j.text_hash") == F.col("f.text_hash"))
    marked = joined.alias("j").join(firsts.alias("f"), "label").select("j.doc_id", "j.text_hash", "times", same.alias("stays"))
    marked = scratch.keep("marked", marked.where("not stays or times > 1"))
    left = _rows_of(documents, marked, "left_anti")
    again = _rows_of(documents, marked.where("stays"), "left_semi")
    one = again.groupBy(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text")).agg(F.min(F.struct(*documents.columns)).alias("_one"))
    return left.unionByName(one.select("_one.*"))

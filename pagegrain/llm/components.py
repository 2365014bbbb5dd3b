"""Connected components and exact linking of candidate buckets, with DataFrames alone.

Every table of a round is written to the shared folder. Buckets of any size cost a
number of rows in proportion to their members in each round: a bucket is compared
by centres, and only across components.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Most centres of a bucket in one round.
CENTRES = 256
#: First rounds that hold an item against centres of its first bucket alone.
NARROW = 2
#: Members of a bucket up to which ``small`` may say that all its pairs are compared at once.
SMALL = 32
#: Members of a bucket that one task holds against its centres; larger buckets are split.
SPLIT = 2000
#: Members outside a bucket's smallest label that are its centres all at once, in place of CENTRES.
WHOLE = 2000
#: Pairs of a round that are verified at once.
FEW = 20_000
#: Links of which the components are found on the driver at most (16 bytes each); more go through rounds of joins.
HERE = 200_000
#: 64-bit parity words of a set: each member flips the bit that the top ten bits of its hash name.
WORDS = 16


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of these links in order, and the smallest id of the component of each."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[one], label[other])
        new = label.copy()
        for ends in (one, other):
            np.minimum.at(new, label[ends], low)
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def connected(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """id and label (the smallest id of its component) of every end of the links a, b.

    A union-find: of HERE links at most on the driver, of more by rounds in which each
    node takes its neighbours' smallest label, then its label's label, until nothing moves.
    """
    links = scratch.keep(f"{name}-links", links.select("a", "b").distinct())
    if links.count() <= HERE:
        table = links.toArrow()
        ids, low = roots(*(table.column(c).to_numpy().astype(np.int64) for c in ("a", "b")))
        return scratch.keep(f"{name}-0", scratch.spark.createDataFrame(pa.table({"id": ids, "label": low}), "id long, label long"))
    both = links.union(links.select("b", "a")).distinct()
    edges = scratch.keep(f"{name}-edges", both.toDF("a", "b"))
    labels = scratch.keep(f"{name}-0", edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label"))
    turn = 0
    while True:
        turn += 1
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        root = step.select(F.col("id").alias("label"), F.col("label").alias("root"))
        moved = scratch.keep(f"{name}-{turn}", step.join(root, "label").select("id", F.col("root").alias("label"), (F.col("root") != F.col("old")).alias("moved")))
        scratch.drop(f"{name}-{turn - 1}")
        labels = moved.select("id", "label")
        if not moved.where("moved").take(1):
            return labels


def merged(scratch: Scratch, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The labels after more links: components of the old labels that these join."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    every = labels.union(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("label")))
    every = scratch.keep(f"{name}-every", every)
    a, b = every.toDF("a", "la"), every.toDF("b", "lb")
    joins = links.join(a, "a").join(b, "b").where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    root = connected(scratch, joins, name).toDF("label", "root")
    out = scratch.keep(f"{name}-merged", every.join(root, "label", "left").select("id", F.coalesce("root", "label").alias("label")))
    scratch.drop(*[f"{name}-{part}" for part in ("every", "links", "edges", "0")])
    return out


def parities(members: DataFrame, key: str, member: str) -> DataFrame:
    """id, the size n and the parity words g0, g1, ... of each set, from a row for each of its members."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.col(member), 54).bitwiseAND(63).cast("int"))
    placed = members.select(F.col(key).alias("id"), F.shiftrightunsigned(F.col(member), 60).cast("int").alias("word"), bit.alias("bit"))
    return placed.groupBy("id").agg(F.count("*").alias("n"), *[F.bit_xor(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"g{w}") for w in range(WORDS)])


def list_parities(sets: DataFrame, key: str, members: str, group: int) -> DataFrame:
    """As ``parities``, from an array of the distinct members of each set, so many of them in a row."""
    rows = sets.select(key, members, F.size(members).cast("long").alias("n"), F.explode(F.expr(f"sequence(0, size({members}) - 1, {group})")).alias("at"))
    # beyond the last member null, which flips no bit
    part = rows.select(key, "n", *[F.get(members, F.col("at") + j).alias(f"h{j}") for j in range(group)])
    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(f"h{j}", 54).bitwiseAND(63).cast("int"))
    placed = part.select(F.col(key).alias("id"), "n", *[c for j in range(group) for c in (F.shiftrightunsigned(f"h{j}", 60).cast("int").alias(f"w{j}"), bit(j).alias(f"b{j}"))])

    def word(w: int) -> Column:
        return F.bit_xor(reduce(Column.bitwiseXOR, [F.when(F.col(f"w{j}") == w, F.col(f"b{j}")).otherwise(F.lit(0).cast("long")) for j in range(group)]))

    return placed.groupBy("id").agg(F.max("n").alias("n"), *[word(w).alias(f"g{w}") for w in range(WORDS)])


def may_link(similarity: int, a: str, b: str) -> Column:
    """False only for pairs below 100 times the similarity, by their sizes and parity words.

    Words differ in no more bits than the sets in members, and sets that link differ in
    no more members than both sizes less twice the least number shared.
    """
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    total = na + nb
    least = F.ceil(total * similarity / F.lit(100.0 + similarity) - F.lit(1e-6))
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{a}.g{w}").bitwiseXOR(F.col(f"{b}.g{w}"))) for w in range(WORDS)])
    return (100 * F.least(na, nb) >= similarity * F.greatest(na, nb)) & (differ <= total - 2 * least)


def _star(scratch: Scratch, live: DataFrame, centres: DataFrame, on: Column) -> DataFrame:
    """Members x with the centres y of their bucket. A large bucket's members are dealt to
    several tasks, each with a copy of its centres."""
    if not live.where(F.col("size") > SPLIT).take(1):
        return live.alias("x").join(centres.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & on)
    # a row for SPLIT members
    parts = F.ceil(F.col("size") / SPLIT).cast("int")
    dealt = live.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    copies = centres.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.alias("x").join(copies.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.part") == F.col("y.part")) & on)


def _joined_by(scratch: Scratch, pairs: DataFrame, count: int, labels: DataFrame, verify: Callable[[DataFrame], DataFrame], verify_few: Callable[[DataFrame], DataFrame], turn: str) -> DataFrame:
    """The labels after so many pairs a, b of components la < lb, of which some link.

    One link joins two components: the first and the last pair of each two are verified
    before the others, and these only where the components are still apart. FEW pairs
    are verified at once.
    """
    if count <= FEW:
        links = scratch.keep(f"links{turn}", verify_few(pairs.select("a", "b")).select("a", "b"))
        scratch.release()
        return merged(scratch, labels, links, f"labels{turn}") if links.take(1) else labels
    ends = pairs.groupBy("la", "lb").agg(F.min(F.struct("a", "b")).alias("low"), F.max(F.struct("a", "b")).alias("high"))
    probes = scratch.keep(f"probes{turn}", ends.select(F.explode(F.array("low", "high")).alias("p")).select("p.a", "p.b").distinct())
    links = scratch.keep(f"links{turn}", verify(probes).select("a", "b"))
    scratch.release()
    if links.take(1):
        labels = merged(scratch, labels, links, f"labels{turn}")
    one, other = labels.select(F.col("id").alias("a"), F.col("label").alias("ra")), labels.select(F.col("id").alias("b"), F.col("label").alias("rb"))
    known = pairs.select("a", "b").join(one, "a", "left").join(other, "b", "left")
    apart = known.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").join(probes, ["a", "b"], "left_anti")
    rest = scratch.keep(f"rest{turn}", apart)
    if rest.take(1):
        more = scratch.keep(f"more{turn}", verify(rest).select("a", "b"))
        scratch.release()
        if more.take(1):
            labels = merged(scratch, labels, more, f"again{turn}")
            scratch.drop(f"labels{turn}-merged")
    scratch.drop(f"probes{turn}", f"links{turn}", f"rest{turn}", f"more{turn}")
    return labels


def link_buckets(scratch: Scratch, first: DataFrame, members: DataFrame, items: DataFrame, similarity: int, verify: Callable[[DataFrame], DataFrame], small: int = 0, verify_few: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """id and label of every item with a verified link, smallest id of its component.

    ``first`` has pairs a < b to verify at once, ``members`` the buckets (bucket, id)
    of any size within which every pair may link, ``items`` the size n and the parity
    words g0, g1, ... of each id of a bucket. The first rounds hold each item
    against one centre and then 16 of its first bucket, which joins most of a large
    group. Two
    components of a bucket are left apart only after all pairs between them have been
    held against each other: each further round takes centres from a bucket, those of
    the largest labels first, compares each with the members of other components, and
    then takes the centres out. From the fourth on, a bucket with WHOLE members at most
    outside the component of the smallest label has all these as centres, and is done.
    A pair is held against each other only in the first of the buckets that it shares. Of a bucket with ``small`` members at most all
    pairs are held against each other in the first round, and it is done. Pairs that
    pass ``may_link`` are verified, of many those of two of each two components before
    the others; FEW pairs by ``verify_few``, if it is given. Buckets of one component are
    done. Buckets are told apart by 64-bit hashes.
    """
    members = members.select(F.xxhash64("bucket").alias("bucket"), "id").distinct()
    if small:
        members = members.join(members.groupBy("bucket").agg(F.count("*").alias("members")), "bucket")
    members = scratch.keep("members", members.join(items, "id"))
    if small:
        few, members = members.where(F.col("members") <= small), members.where(F.col("members") > small).drop("members")
        both = few.alias("x").join(few.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id")) & may_link(similarity, "x", "y"))
        near = scratch.keep("near", both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
        first = first.select("a", "b").union(near)
    data = [c for c in members.columns if c not in ("bucket", "id")]
    # a row for each item, so that its label is looked up once a round: all its buckets and those that are left
    nodes = members.groupBy("id").agg(*[F.first(c).alias(c) for c in data], F.collect_list("bucket").alias("all"))
    nodes = scratch.keep("nodes", nodes.withColumn("left", F.col("all")))
    labels = tried = None  # tried: the pairs of the first rounds
    turn = 0
    while True:
        turn += 1
        named = nodes.withColumn("label", F.col("id")) if turn == 1 else nodes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        known = named.select("id", *data, "all", "label", F.explode(F.array(F.array_min("all")) if turn <= NARROW else F.col("left")).alias("bucket"))
        known = scratch.keep(f"known{turn}", known)
        # sizes by label, so that a large bucket's are summed up in many tasks
        counts = known.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket")
        open_ = counts.agg(F.sum("n").alias("size"), F.min(F.struct("label", "n")).alias("low"), F.count("*").alias("labels")).where("labels > 1")
        open_ = open_.select("bucket", "size", F.col("low.label").alias("low"), (F.col("size") - F.col("low.n")).alias("rest"))
        live = scratch.keep(f"live{turn}", known.join(open_, "bucket"))
        scratch.drop(f"known{turn}")
        if turn > NARROW:
            scratch.drop(f"nodes{turn - 1}" if turn > NARROW + 1 else "nodes")
        # each slot of a bucket has one centre: the largest id of its largest label
        slots = (1, 16, 32, CENTRES)[min(turn, 4) - 1]
        slot = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(slots))
        apart = F.col("x.id") != F.col("y.id") if turn == 1 else F.col("x.label") != F.col("y.label")
        some = live.where(F.col("rest") > WHOLE) if turn >= 4 else live
        best = some.groupBy("bucket", slot.alias("slot")).agg(F.max(F.struct("label", "id")).alias("top")).select("bucket", F.col("top.id").alias("id"))
        centres = some.join(best, ["bucket", "id"]).select(live.columns)
        if turn >= 4:
            centres = centres.union(live.where((F.col("rest") <= WHOLE) & (F.col("label") != F.col("low"))))
            apart &= (F.col("x.rest") > WHOLE) | (F.col("x.label") == F.col("x.low")) | (F.col("x.id") < F.col("y.id"))
        centres = scratch.keep(f"centres{turn}", centres)
        apart &= may_link(similarity, "x", "y")
        if turn > NARROW:
            apart &= F.array_min(F.array_intersect("x.all", "y.all")) == F.col("x.bucket")
        star = _star(scratch, live, centres, apart)
        star = star.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.least("x.label", "y.label").alias("la"), F.greatest("x.label", "y.label").alias("lb"))
        # in the first round every item is its own label
        pairs = (first.select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb")).union(star) if turn == 1 else star).distinct()
        if 1 < turn <= NARROW:  # later centres leave the bucket in which their pairs are held against each other
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.keep(f"pairs{turn}", pairs)
        told = pairs.select("a", "b")
        tried = told if turn == 1 else tried.union(told)
        if turn == 1:
            labels = connected(scratch, scratch.keep("links1", verify(told).select("a", "b")), "labels1")
        elif count := pairs.count():
            labels = _joined_by(scratch, pairs, count, labels, verify, verify_few or verify, f"{turn}")
        if turn > NARROW:
            left = some.join(centres.select("bucket", "id"), ["bucket", "id"], "left_anti")
            left = left.groupBy("id").agg(*[F.first(c).alias(c) for c in (*data, "all")], F.collect_list("bucket").alias("left"))
            nodes = scratch.keep(f"nodes{turn}", left)
        scratch.drop(f"live{turn}", f"centres{turn}")
        scratch.release()
        if not nodes.take(1):
            return labels

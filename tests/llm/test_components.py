"""Union-find on the driver and by joins against a plain one, and the line stage's sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegrain.llm import components, line_dedup
from pagegrain.llm.scratch import Scratch


def plain(links):
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {x: find(x) for x in parent}


def some_links(seed):
    rng = random.Random(seed)
    chain = [(i, i + 1) for i in range(-50, 0)]
    return chain + [(rng.randrange(1, 400), rng.randrange(1, 400)) for _ in range(150)] + [(2**62, -(2**62))]


@pytest.mark.parametrize("seed", range(5))
def test_roots(seed):
    links = some_links(seed)
    ids, low = components.roots(*np.array(links, np.int64).T)
    assert dict(zip(ids.tolist(), low.tolist(), strict=True)) == plain(links)


@pytest.mark.parametrize("here", [0, 1000])
def test_connected(spark, monkeypatch, here):
    monkeypatch.setattr(components, "HERE", here)
    links = some_links(7)
    got = components.connected(Scratch(spark, "connected"), spark.createDataFrame(links, "a long, b long"), "links")
    assert {r.id: r.label for r in got.collect()} == plain(links)
    assert components.connected(Scratch(spark, "connected"), spark.createDataFrame([], "a long, b long"), "links").count() == 0


def test_sets_and_the_pairs_that_may_link(spark):
    """Of lines with repeated shingles and without, and of all lengths beside a whole number of rows."""
    rng = random.Random(4)
    lines = ["".join(rng.choices("abcdefgh ", k=rng.randint(8, 400))) for _ in range(40)] + ["ab" * n for n in range(4, 20)] + ["x" * n for n in (8, 9, 30)]
    lines += [line[: rng.randint(0, 9)] + line[rng.randint(0, 30) :] + rng.choice(["", "z", "a tail of it"]) for line in lines for _ in range(3)]
    lines = sorted({line for line in lines if len(line) >= 8})
    sets = [{line[i : i + 8] for i in range(len(line) - 7)} for line in lines]
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and 100 * len(a & b) >= 80 * len(a | b)}
    own = line_dedup._sets(spark.createDataFrame(list(enumerate(lines)), "key long, line string"))
    assert {r.key: (len(r.s), len(set(r.s))) for r in own.collect()} == {i: (len(x), len(x)) for i, x in enumerate(sets)}
    items = components.parities(own.select("key", F.explode("s").alias("h")), "key", "h")
    x, y = items.alias("x"), items.alias("y")
    got = {tuple(r) for r in x.join(y, (F.col("x.id") < F.col("y.id")) & components.may_link(line_dedup.SIMILARITY, "x", "y")).select("x.id", "y.id").collect()}
    assert len(want) > 50 and want <= got and len(got) < len(lines) ** 2 // 4


def test_few_links_take_two_tables(spark, monkeypatch):
    """A chain took a round of joins and a table for each doubling."""
    kept = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, name, df: kept.append(name) or keep(self, name, df))
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert components.connected(Scratch(spark, "connected"), links, "links").where("label = 0").count() == 201
    assert len(kept) == 2


def test_parities_of_lists(spark):
    """The same words from arrays of any length as from a row for each member."""
    rng = random.Random(8)
    sets = spark.createDataFrame([(i, [rng.randrange(-(2**63), 2**63) for _ in range(n)]) for i, n in enumerate((1, 7, 8, 9, 40, 301))], "key long, s array<long>")
    want = components.parities(sets.select("key", F.explode("s").alias("h")), "key", "h")
    assert sorted(components.list_parities(sets, "key", "s", 8).collect()) == sorted(want.collect())


@pytest.mark.parametrize("small", [0, 6])
def test_small_buckets_take_one_round(spark, monkeypatch, small):
    """A bucket whose members are apart took a round for each few of its centres."""
    kept = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, name, df: kept.append(name) or keep(self, name, df))
    ids = list(range(40))
    sets = spark.createDataFrame([(i, [random.Random(i // 2 * 100 + k).randrange(-(2**63), 2**63) for k in range(10 - i % 2)]) for i in ids], "id long, s array<long>")
    members = spark.createDataFrame([(f"s{i // 4}", i) for i in ids] + [("one", i) for i in ids[:7]], "bucket string, id long")
    items = components.list_parities(sets, "id", "s", 8)
    first = spark.createDataFrame([], "a long, b long")
    scratch = Scratch(spark, "linked")

    def verify(pairs):
        a, b = sets.toDF("a", "sa"), sets.toDF("b", "sb")
        return pairs.join(a, "a").join(b, "b").where(5 * F.size(F.array_intersect("sa", "sb")) >= 4 * F.size(F.array_union("sa", "sb"))).select("a", "b")

    got = components.link_buckets(scratch, first, members, items, 80, verify, small)
    assert {r.id: r.label for r in got.collect()} == {i: i // 2 * 2 for i in ids}
    assert small == 0 or spark.read.parquet(scratch.path("near")).count() >= 20
    kept.clear()
    components.link_buckets(scratch, first, members.where("bucket != 'one'"), items, 80, verify, small)
    assert ("live2" in kept) == (small == 0)


@pytest.mark.parametrize(("small", "whole", "few", "split"), [(0, 2000, 20_000, 2000), (6, 0, 0, 1), (6, 3, 20_000, 5)])
def test_linked_pairs_of_overlapping_buckets(spark, monkeypatch, small, whole, few, split):
    """The components of all pairs that share a bucket, whether what is left of a bucket is compared at once or not."""
    for name, value in (("WHOLE", whole), ("FEW", few), ("SPLIT", split), ("CENTRES", 4)):
        monkeypatch.setattr(components, name, value)
    rng = random.Random(3)
    base = [[rng.randrange(-(2**63), 2**63) for _ in range(40)] for _ in range(12)]
    own = [rng.choice(base)[: rng.randint(25, 40)] for _ in range(120)]
    buckets = [(f"b{k}", i) for i in range(len(own)) for k in rng.sample(range(9), rng.randint(0, 4))] + [(f"c{i // 3}", i) for i in range(len(own))]
    sets = spark.createDataFrame(list(enumerate(own)), "id long, s array<long>")
    held = {frozenset((i, j)) for b, i in buckets for c, j in buckets if b == c and i < j}
    links = [(i, j) for i, j in map(sorted, held) if 5 * len({*own[i]} & {*own[j]}) >= 4 * len({*own[i]} | {*own[j]})]

    def verify(pairs):
        a, b = sets.toDF("a", "sa"), sets.toDF("b", "sb")
        return pairs.join(a, "a").join(b, "b").where(5 * F.size(F.array_intersect("sa", "sb")) >= 4 * F.size(F.array_union("sa", "sb"))).select("a", "b")

    first = spark.createDataFrame([], "a long, b long")
    got = components.link_buckets(Scratch(spark, "linked"), first, spark.createDataFrame(buckets, "bucket string, id long"), components.list_parities(sets, "id", "s", 8), 80, verify, small)
    assert {r.id: r.label for r in got.collect()} == plain(links)


def test_items_meet_once_in_their_buckets(spark, monkeypatch):
    """Unlinked items that share many buckets took several rounds, and a row for each bucket and pair of a round."""
    kept, made = [], []
    keep, star = Scratch.keep, components._star
    monkeypatch.setattr(Scratch, "keep", lambda self, name, df: kept.append(name) or keep(self, name, df))

    def counted(scratch, live, centres, on):
        out = star(scratch, live, centres, on)
        made.append(out.count())
        return out

    monkeypatch.setattr(components, "_star", counted)
    monkeypatch.setattr(components, "CENTRES", 8)
    # pairs pass by their parity words: nine members, ten or so in common with the same word
    sets = spark.createDataFrame([(i, list(range(20))) for i in range(60)], "id long, s array<long>")
    members = spark.createDataFrame([(b, i) for b in range(10) for i in range(60)], "bucket long, id long")
    first = spark.createDataFrame([], "a long, b long")
    got = components.link_buckets(Scratch(spark, "linked"), first, members, components.list_parities(sets, "id", "s", 8), 80, lambda pairs: pairs.where("false"))
    assert got.count() == 0
    assert "live5" not in kept and sum(made[2:]) <= 60 * 59 + 16 * 60

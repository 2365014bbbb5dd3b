"""Fuzzy line dedup on lines that are similar and not equal, of several lengths."""

import random
import string

import pytest
from pyspark.sql import functions as F

from pagegrain.llm import components, line_dedup

LENGTHS = (25, 43, 97)


def shingles(line):
    return {line[i : i + 8] for i in range(len(line) - 7)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def near_pairs(low, high, each, seed):
    """Unequal lines whose similarity lies in [low, high), ``each`` of every length."""
    rng, out = random.Random(seed), []
    for n in LENGTHS:
        found = 0
        while found < each:
            a = "".join(rng.choices(string.ascii_lowercase, k=n))
            cut = rng.randint(1, n // 4)
            b = a[cut:] + "".join(rng.choices(string.ascii_lowercase, k=rng.randint(0, cut)))
            if low <= jaccard(shingles(a), shingles(b)) < high:
                out.append((n, a, b))
                found += 1
    return out


@pytest.fixture(scope="module")
def recall(spark):
    """Of each length, the part of pairs at the threshold that are candidates."""
    pairs = spark.createDataFrame(near_pairs(0.8, 0.83, 600, 5), "n int, a string, b string").withColumns({"ka": F.xxhash64("a"), "kb": F.xxhash64("b")})
    bands = line_dedup._bands(pairs.select(F.col("ka").alias("key"), F.col("a").alias("line")).union(pairs.select("kb", "b")))
    both = pairs.join(bands.toDF("ka", "x"), "ka").join(bands.toDF("kb", "y"), "kb")
    return {r.n: r.found for r in both.groupBy("n").agg(F.avg(F.arrays_overlap("x", "y").cast("int")).alias("found")).collect()}


def test_recall_at_the_threshold(recall):
    assert set(recall) == set(LENGTHS) and min(recall.values()) >= 0.98


def test_bands_lose_next_to_nothing(recall):
    assert (1 - (line_dedup.SIMILARITY / 100) ** line_dedup.ROWS) ** line_dedup.BANDS < 0.0005
    assert min(recall.values()) >= 0.998


@pytest.mark.parametrize(("keys", "share", "split"), [(1_000_000, 1000, 2000), (0, 1, 1)])
def test_against_all_pairs(spark, monkeypatch, keys, share, split):
    """Short and long near copies and exact copies of very short lines against all pairs, by broadcasts and
    by shuffles, with all components hot and none, and with buckets whole and split."""
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", keys)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    monkeypatch.setattr(components, "SPLIT", split)
    rng = random.Random(9)
    lines = [x for _, a, b in near_pairs(0.84, 0.97, 8, 3) + near_pairs(0.6, 0.78, 8, 4) for x in (a, b)]
    lines += ["Home", "Home", "twelve chars", "twelve chars!", "", "", "\t", "\t"] + lines[:6]
    rng.shuffle(lines)
    docs = [(i, lines[4 * i : 4 * i + 4]) for i in range((len(lines) + 3) // 4)]
    places = [(i, k, line) for i, own in docs for k, line in enumerate(own) if line.strip()]
    parent = list(range(len(places)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, _, a) in enumerate(places):
        for j, (_, _, b) in enumerate(places[:i]):
            if a == b or (min(len(a), len(b)) >= 8 and 5 * len(shingles(a) & shingles(b)) >= 4 * len(shingles(a) | shingles(b))):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    want = {i: [] for i, _ in docs}
    for i, (doc, k, _) in enumerate(places):
        if find(i) != i:
            want[doc].append(k)
    got = line_dedup.line_dedup(spark.createDataFrame([(i, "\n".join(own)) for i, own in docs], "doc_id long, text string"))
    assert {r.doc_id: r.dropped_lines for r in got.collect()} == want
    assert sum(map(len, want.values())) >= 8 * len(LENGTHS)

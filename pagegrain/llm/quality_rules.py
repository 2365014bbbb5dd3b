"""Quality rules: document statistics, base rules and gradient-boosted trees.

The statistics come from numpy passes over the bytes of a batch. The trees are
fitted on a bounded sample of labelled rows by histograms and second-order
logistic gain, with monotonic constraints on chosen features, and are then flat
node arrays that score a batch in one pass for each level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Text, array_chunks, inner, windows

#: Bound of the labelled rows that are learned from, the first by a hash of doc_id.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, MIN_ROWS, L2 = 60, 3, 48, 0.15, 20, 1.0
#: A document is kept if the trees give this probability of quality or more.
KEEP_AT = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "marks", "bangs", "bars", "line_words", "stops")
#: -1: the more, the worse.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeat_words": -1, "upper": -1, "bangs": -1, "bars": -1}


def _class(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _class("#*$%&|<>"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_MARK, _BANG, _BAR, _STOP = _class(",;:.!?\"'()-"), _class("!"), _class("|"), _class(".?!")
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The base counts (rows x 5, int64) and the features (rows x 12) of each text; null reads as empty."""
    text = Text(column)
    starts, ends = text.words()
    n_words = text.between(starts)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[text.offsets[1:]] - sums[text.offsets[:-1]]

    def of(table: np.ndarray) -> np.ndarray:
        return total(table[text.data])

    lead = _LEAD[text.data]
    lead_sums = np.zeros(len(lead) + 1, np.int64)
    np.cumsum(lead, out=lead_sums[1:])
    word_sums = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lead_sums[ends] - lead_sums[starts], out=word_sums[1:])
    word_ends = np.cumsum(n_words)
    word_chars = word_sums[word_ends] - word_sums[word_ends - n_words]

    line_starts, line_ends, line_own = text.lines()
    line_words = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
    filled = line_words > 0
    hashed = text.hashes(line_starts[filled], line_ends[filled])
    own = line_own[filled]
    order = np.lexsort((hashed, own))
    again = (hashed[order][1:] == hashed[order][:-1]) & (own[order][1:] == own[order][:-1])
    n_dup_lines = np.bincount(own[order][1:][again], minlength=text.n)
    n_lines = np.bincount(own, minlength=text.n)

    words = text.hashes(starts, ends)
    at = np.flatnonzero(inner(n_words, 3, len(words)))
    triple = windows(words, 3)[at]
    word_own = np.repeat(np.arange(text.n), n_words)
    order = np.lexsort((triple, word_own[at]))
    same = (triple[order][1:] == triple[order][:-1]) & (word_own[at][order][1:] == word_own[at][order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[at[twice] + i] = True
    n_repeat = np.bincount(word_own[covered], minlength=text.n)

    n_symbols = of(_SYMBOL)
    base = np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat], 1).astype(np.int64)
    chars, many = np.maximum(1, word_chars), np.maximum(1, n_words)
    features = np.stack([np.log1p(n_words), word_chars / many, n_symbols / many, n_dup_lines / np.maximum(1, n_lines), n_repeat / many, of(_UPPER) / chars, of(_DIGIT) / chars, of(_MARK) / many, of(_BANG) / many, of(_BAR) / many, np.log1p(n_words / np.maximum(1, n_lines)), of(_STOP) / many], 1)
    return base, features


def base_failed(base: np.ndarray) -> np.ndarray:
    """Fewer than 50 words, or over half of them in repeated three-word windows."""
    return (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])


@dataclass
class Trees:
    """Node arrays, trees x nodes; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray
    start: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(features), len(self.feature)), np.int64)
        rows = np.arange(len(features))[:, None]
        for _ in range(DEPTH):
            less = features[rows, self.feature[trees, node]] <= self.threshold[trees, node]
            node = np.where(less, self.below[trees, node], self.above[trees, node])
        return 1 / (1 + np.exp(-(self.start + self.value[trees, node].sum(1))))


def fit(features: np.ndarray, good: np.ndarray) -> Trees | None:
    """Boosted trees; None if there are not rows of both kinds."""
    if len(set(good.tolist())) < 2:
        return None
    sign = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    cuts = [np.unique(np.quantile(features[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(features.shape[1])]
    binned = np.stack([np.searchsorted(c, features[:, f], side="left") for f, c in enumerate(cuts)], 1)
    y = good.astype(float)
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), start)
    nodes = 2 ** (DEPTH + 1) - 1
    shape = (TREES, nodes)
    out = Trees(np.zeros(shape, np.int64), np.zeros(shape), np.tile(np.arange(nodes), (TREES, 1)), np.tile(np.arange(nodes), (TREES, 1)), np.zeros(shape), start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, np.maximum(p * (1 - p), 1e-6)
        where = np.zeros(len(y), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for node in range(nodes):
            if node not in bounds:
                continue
            rows = np.flatnonzero(where == node)
            low, high = bounds[node]
            g, h = gradient[rows].sum(), hessian[rows].sum()
            out.value[t, node] = RATE * np.clip(g / (h + L2), low, high)
            if 2 * node + 2 >= nodes or len(rows) < 2 * MIN_ROWS:
                continue
            best = (1e-6, -1, -1, 0.0, 0.0)
            for f in range(binned.shape[1]):
                size = len(cuts[f]) + 1
                if size < 2:
                    continue
                gs = np.cumsum(np.bincount(binned[rows, f], gradient[rows], size))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, f], hessian[rows], size))[:-1]
                ns = np.cumsum(np.bincount(binned[rows, f], minlength=size))[:-1]
                left, right = np.clip(gs / (hs + L2), low, high), np.clip((g - gs) / (h - hs + L2), low, high)
                gain = gs**2 / (hs + L2) + (g - gs) ** 2 / (h - hs + L2) - g**2 / (h + L2)
                ok = (ns >= MIN_ROWS) & (len(rows) - ns >= MIN_ROWS) & (sign[f] * (right - left) >= 0)
                gain = np.where(ok, gain, -1)
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (float(gain[b]), f, b, float(left[b]), float(right[b]))
            if best[1] < 0:
                continue
            _, f, b, left, right = best
            out.feature[t, node], out.threshold[t, node] = f, cuts[f][b]
            out.below[t, node], out.above[t, node] = 2 * node + 1, 2 * node + 2
            where[rows] = np.where(binned[rows, f] <= b, 2 * node + 1, 2 * node + 2)
            middle = (left + right) / 2
            bounds[2 * node + 1] = (low, middle) if sign[f] > 0 else (middle, high) if sign[f] < 0 else (low, high)
            bounds[2 * node + 2] = (middle, high) if sign[f] > 0 else (low, middle) if sign[f] < 0 else (low, high)
        margin += out.value[t, where]
    return out


def train(documents: DataFrame, labels: DataFrame) -> Trees | None:
    """Learn from at most SAMPLE labelled documents. A doc_id with several labels counts as its lowest one."""

    @F.arrow_udf("array<double>")
    def features(column: pa.Array) -> pa.Array:
        rows = [row for part in array_chunks(column) for row in statistics(part)[1].tolist()]
        return pa.array(rows, pa.list_(pa.float64()))

    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # chosen has SAMPLE rows of two numbers at most
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").limit(2 * SAMPLE).select("quality", features("text").alias("x")).collect()
    if not rows:
        return None
    order = sorted((r["x"], r["quality"]) for r in rows)
    return fit(np.array([x for x, _ in order]), np.array([q > 0 for _, q in order]))


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the trees' probability of every document.

    Null text has no words and fails. Repeated rows each keep their row. Without
    labels of both kinds the base rules alone decide and the probability is null.
    Other columns are not read.
    """
    trees = train(documents, labels)
    kind = ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, probability double"

    @F.arrow_udf(kind)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [statistics(part) for part in array_chunks(column)] or [(np.zeros((0, 5), np.int64), np.zeros((0, len(FEATURES))))]
            base, features = (np.concatenate(x) for x in zip(*parts, strict=True))
            failed = base_failed(base)
            p = trees.probability(features) if trees else np.full(len(base), np.nan)
            arrays = [*(pa.array(base[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & ~(p < KEEP_AT)), pa.array(p, from_pandas=True)]
            yield pa.StructArray.from_arrays(arrays, names=[*BASE, "base_failed", "kept", "probability"])

    return documents.select("doc_id", run("text").alias("_rules")).select("doc_id", "_rules.*")

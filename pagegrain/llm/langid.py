"""Language identification with string kernels.

A text is the set of its character n-grams of 1 to 3 characters (blended
spectrum, presence only; lower case, every run outside letters is one space).
The kernel of two texts is the number of shared n-grams over the geometric mean
of their counts. Landmark texts give a Nyström map, and a ridge regression per
language, one against the rest, is solved in that map. The kernel is linear in
the presence vectors, so landmarks and weights fold into one matrix and a batch
of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import array_chunks
from .names import fresh

UNDETERMINED = "und"
#: n-grams are hashed into this many presence cells.
CELLS = 1 << 15
ORDERS = (1, 2, 3)
#: Bounds of the training sample, for each language, and of its landmarks.
SAMPLE_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 64
RIDGE = 1e-2
#: Margins are turned into shares by a softmax of this slope.
SLOPE = 6.0
#: The pipeline rejects what scores less.
MIN_SCORE = 0.4
#: Texts of one matrix product: CELLS bytes each, and four times that as numbers.
ROWS = 128
#: Languages that can be learned, the most frequent ones; the model is CELLS numbers for each.
MAX_LANGUAGES = 256
#: Parts of a language in which its sample is first looked for.
SALTS = 32

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """One row of 0 and 1 for each text, and whether it has a letter."""
    out = np.zeros((len(texts), CELLS), np.uint8)
    joined = "\0".join((t or "").replace("\0", " ") for t in texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    letter = _letter_table()[points]
    own = np.cumsum(points == 0)
    has = np.zeros(len(texts), bool)
    has[own[letter]] = True
    signs = np.where(letter, points, np.uint32(32)).astype(np.uint64)
    signs[points == 0] = 0
    fresh = np.ones(len(signs), bool)
    fresh[1:] = (signs[1:] != 32) | (signs[:-1] != 32)
    signs, own = signs[fresh], own[fresh]
    with np.errstate(over="ignore"):
        for order in ORDERS:
            n = len(signs) - order + 1
            if n <= 0:
                continue
            code = np.full(n, order, np.uint64)
            inside = np.ones(n, bool)
            for i in range(order):
                code = (code ^ signs[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                inside &= signs[i : i + n] != 0
            cells = (code >> np.uint64(64 - 15)).astype(np.int64)
            out.ravel()[(own[:n] * CELLS + cells)[inside]] = 1
    return out, has


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # cells x languages
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 for null or no letter."""
        rows, has = presence(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        norm = np.sqrt(np.maximum(1, rows.sum(1, dtype=np.int64)))
        margin = (rows.astype(np.float32) @ self.weights) / norm[:, None] + self.bias
        share = np.exp(SLOPE * (margin - margin.max(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        score = np.where(has, share[np.arange(len(texts)), best], 0.0)
        return [self.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)], score


def fit(rows: np.ndarray, langs: list[str]) -> Model:
    """Ridge regression on Nyström features; rows are packed presence bits."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((CELLS, 0), np.float32), np.zeros(0))
    lang = np.array(langs)
    marks = np.concatenate([np.flatnonzero(lang == x)[:LANDMARKS_PER_LANGUAGE] for x in languages])

    def normal(at: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(rows[at], axis=1).astype(np.float32)
        return bits / np.sqrt(np.maximum(1, bits.sum(1)))[:, None]

    landmarks = normal(marks)
    kernel = np.concatenate([normal(np.arange(i, min(i + 128, len(rows)))) @ landmarks.T for i in range(0, len(rows), 128)]).astype(np.float64)
    value, vector = np.linalg.eigh(kernel[marks])
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    mapped = kernel @ root
    target = np.where(lang[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # each language weighs the same, however many rows it has
    weight = np.array([1.0 / (langs.count(x) * len(languages)) for x in languages])[[languages.index(x) for x in langs]]
    mean, aim = weight @ mapped, weight @ target
    centred = (mapped - mean) * np.sqrt(weight)[:, None]
    solved = np.linalg.solve(centred.T @ centred + RIDGE / len(rows) * np.eye(mapped.shape[1]), centred.T @ ((target - aim) * np.sqrt(weight)[:, None]))
    return Model(languages, (landmarks.T.astype(np.float64) @ (root @ solved)).astype(np.float32), aim - mean @ solved)


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null id reads as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(documents: DataFrame) -> Model:
    """Learn from at most SAMPLE_PER_LANGUAGE ids of each of MAX_LANGUAGES languages, the first by a hash
    of doc_id, none of them held out. Rows with null text or lang teach nothing."""

    @F.arrow_udf("binary")
    def packed(column: pa.Array) -> pa.Array:
        out: list[bytes] = []
        for part in array_chunks(column, rows=ROWS):
            out += [r.tobytes() for r in np.packbits(presence(part.to_pylist())[0], axis=1)]
        return pa.array(out, pa.binary())

    rows = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    most = rows.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(MAX_LANGUAGES)
    languages = [r["lang"] for r in most.collect()]
    # a part hands on SAMPLE_PER_LANGUAGE ids, so a language's last choice is among a bounded number
    ids = rows.where(F.col("lang").isin(languages)).select("lang", "doc_id", F.xxhash64("doc_id").alias("hash")).withColumn("salt", F.pmod("hash", F.lit(SALTS)))
    for parts in (("lang", "salt"), ("lang",)):
        place = F.row_number().over(Window.partitionBy(*parts).orderBy("hash", "doc_id"))
        ids = ids.dropDuplicates(["lang", "doc_id"]) if "salt" in parts else ids
        ids = ids.withColumn("place", place).where(F.col("place") <= SAMPLE_PER_LANGUAGE).drop("place")
    # ids holds SAMPLE_PER_LANGUAGE rows for each of MAX_LANGUAGES at most
    picked = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).join(F.broadcast(ids.select("lang", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"))), ["lang", "key"], "left_semi")
    # of rows that repeat an id the first by a hash of the text
    sample = picked.groupBy("lang", "key").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = sorted(((r["lang"], r["key"], bytes(r["bits"])) for r in sample.select("lang", "key", packed("text").alias("bits")).collect()))
    if not got:
        return fit(np.zeros((0, CELLS // 8), np.uint8), [])
    return fit(np.stack([np.frombuffer(bits, np.uint8) for _, _, bits in got]), [x for x, _, _ in got])


def classify(text: Column | str, model: Model) -> Column:
    """A struct of lang_pred and score, from the whole text alone."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            names: list[str] = []
            scores: list[np.ndarray] = []
            for part in array_chunks(column, rows=ROWS):
                name, score = model.predict(part.to_pylist())
                names += name
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], fields=list(kind))

    return run(text)


def language_id(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Null or letterless text gives ``und`` with score 0, as does every text when no
    row can be learned from. Repeated rows and ids each keep a row of their own;
    other columns are not read.
    """
    model = train(documents)
    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), classify(F.col("text"), model).alias("_lid")).select("doc_id", "held_out", "_lid.lang_pred", "_lid.score")


def accepted(documents: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents, all columns as they were, whose language is told with ``min_score`` or more.

    Null and letterless texts go; an empty table stays empty.
    """
    model = train(documents)
    mark = fresh(documents, "lid")
    return documents.withColumn(mark, classify(F.col("text"), model)).where((F.col(f"{mark}.lang_pred") != UNDETERMINED) & (F.col(f"{mark}.score") >= min_score)).drop(mark)

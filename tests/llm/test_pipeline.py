"""The pipeline's stages one after another, each held against what it was given."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from pagegrain.llm import langid, line_dedup, mixing, ngram_join, tokens

from .test_operators import ROWS, SCHEMA, shingles


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The input and each stage's rows, written and read again."""
    root = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, root).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append((name, docs))
    return root, dict(out)


def test_stages(tables):
    _, by = tables
    rows = {name: df.collect() for name, df in by.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "mix_sources", "best_fit_packing"]
    columns = by["documents"].columns
    assert all(by[n].columns == columns for n in ("language_id", "line_dedup", "ngram_join", "mix_sources"))
    # language: what the operator tells, and no document of the two languages goes
    told = {(r.doc_id, r.lang_pred != "und" and r.score >= langid.MIN_SCORE) for r in langid.language_id(by["documents"]).collect()}
    kept = {r.doc_id for r in rows["language_id"]}
    assert kept == {i for i, good in told if good} and set(range(60)) <= kept
    # lines: each is one of the document's own, and no long line is left in two documents
    before = collections.defaultdict(list)
    for r in rows["language_id"]:
        before[r.doc_id].append(r.text.split("\n"))
    for r in rows["line_dedup"]:
        assert any(set(r.text.split("\n")) <= set(own) for own in before[r.doc_id])
    owners = collections.defaultdict(set)
    for r in rows["line_dedup"]:
        for line in r.text.split("\n"):
            if len(line) >= line_dedup.MIN_CHARS:
                owners[line].add(r.doc_id)
    assert max(map(len, owners.values())) == 1
    # near copies: no two that are left link, and each that went links to a chain that ends in one that stayed
    sets = [shingles(r.text) for r in rows["ngram_join"]]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            both = len(a & b)
            assert not both or 100 * both < ngram_join.SIMILARITY * (len(a) + len(b) - both)
    left = {(r.doc_id, r.text) for r in rows["ngram_join"]}
    assert left <= {(r.doc_id, r.text) for r in rows["line_dedup"]}
    # the mix: each row as often as its operator takes it
    times = collections.Counter((r.doc_id, r.text) for r in rows["mix_sources"])
    taken = collections.Counter()
    for r in mixing.mix_sources(by["ngram_join"]).collect():
        taken[r.doc_id] += r.taken // r["size"] if r["size"] else 1
    assert collections.Counter({k: v for k, v in taken.items() if v}) == collections.Counter(k[0] for k in times.elements())
    # packing: all tokens of all rows, in sequences that hold them without gaps
    library = tokens.encoder().library
    want = collections.Counter()
    for (doc, text), n in times.items():
        want[doc] += n * (1 + len(library.encode(text or "", add_special_tokens=False).ids))
    got, bins = collections.Counter(), collections.defaultdict(list)
    for r in rows["best_fit_packing"]:
        got[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for own in bins.values():
        offsets, lengths = np.array(sorted(own)).T
        assert (offsets == np.cumsum(lengths) - lengths).all() and lengths.sum() <= 2048


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

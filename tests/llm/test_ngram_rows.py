"""Near copies whose rows repeat a doc_id or have none."""

import random

from pagegrain.llm import ngram_join

SCHEMA = "doc_id long, text string, source string"


def test_rows_not_doc_ids_decide(spark):
    rng = random.Random(2)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(4))
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (2, c, "y"), (2, c, "x"), (None, c, "x"), (None, d, "x"), (None, d + " more", "x"), (8, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = ngram_join.representatives(docs)
    assert (5, b, "x") in {tuple(r) for r in kept.collect()}  # another row of doc_id 5 is the copy
    single = ngram_join.singles(docs)
    assert single.columns == docs.columns
    got = [tuple(r) for r in single.collect()]
    last = [r for r in got if r[1] and r[1].startswith(d)]
    assert len(last) == 1 and last[0][0] is None
    assert sorted(map(str, got)) == sorted(map(str, [(1, a, "x"), (5, b, "x"), (2, c, "x"), last[0], (8, None, "x"), (None, "", "x")]))

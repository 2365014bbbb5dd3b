"""Every registered query against its SQL in DuckDB, and without one against plain Python."""

import os

import duckdb
import pytest

from pagegrain.plans import registry
from pagegrain.sources.tables import boxes

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def rows(values):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in values), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = rows(tuple(r[c] for c in columns) for r in df.collect())
    result = duck.sql(registry.oracle_sql()[name])
    at = [result.columns.index(c) for c in columns]
    assert sorted(result.columns) == columns
    assert got == rows(tuple(r[i] for i in at) for r in result.fetchall())


def test_greedy_dedup(spark):
    pages = {}
    for b in boxes(spark, DIR).collect():
        pages.setdefault(b.page, []).append(b)
    want = set()
    for page, found in pages.items():
        kept = []
        for b in sorted(found, key=lambda b: (-b.confidence, (b.x1 - b.x0) * (b.y1 - b.y0), b.pos)):
            def near(k):
                w, h = min(b.x1, k.x1) - max(b.x0, k.x0), min(b.y1, k.y1) - max(b.y0, k.y0)
                return w > 0 and h > 0 and w * h >= 0.7 * min((b.x1 - b.x0) * (b.y1 - b.y0), (k.x1 - k.x0) * (k.y1 - k.y0))
            if not any(near(k) for k in kept):
                kept.append(b)
        want |= {(page, b.pos) for b in kept}
    assert {(r.page, r.pos) for r in registry.queries()["q_greedy_dedup"](spark, DIR).collect()} == want


def test_streams(spark, tmp_path):
    from pagegrain.sources.tables import table
    from pagegrain.streaming.events import read_events, status_counts

    table(spark, DIR, "events").write.parquet(str(tmp_path / "events"))
    stream = status_counts(read_events(spark, str(tmp_path / "events")))
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.table("counts").groupBy().sum("n").first()[0]
    assert got == table(spark, DIR, "events").count()


def test_distinct_boxes(spark):
    pages = {}
    for b in sorted(boxes(spark, DIR).collect(), key=lambda b: b.pos):
        kept = pages.setdefault(b.page, [])
        if all(max(abs(b[n] - k[n]) for n in ("x0", "y0", "x1", "y1")) > 40 for k in kept):
            kept.append(b)
    got = {(r.page, r.pos) for r in registry.queries()["q_distinct_boxes"](spark, DIR).collect()}
    assert got == {(b.page, b.pos) for kept in pages.values() for b in kept}
    assert len(got) < boxes(spark, DIR).count()

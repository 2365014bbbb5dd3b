"""The operators as queries over the ``documents`` table, and their SQL where there is some."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import importance, langid, line_dedup, media, mixing, ngram_join, packing, quality_rules, sharding, token_output


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": lambda s, d: ngram_join.ngram_join(_documents(s, d)),
        "op2_media_columns": lambda s, d: media.media_columns(_documents(s, d)),
        "op3_line_dedup": lambda s, d: line_dedup.line_dedup(_documents(s, d)),
        "op4_token_output": lambda s, d: token_output.token_output(_documents(s, d)),
        "op5_language_id": lambda s, d: langid.language_id(_documents(s, d)),
        "op6_mix_sources": lambda s, d: mixing.mix_sources(_documents(s, d)),
        "op7_quality_rules": lambda s, d: quality_rules.quality_rules(_documents(s, d), _table(s, d, "labels")),
        "op8_hilbert_shards": lambda s, d: sharding.hilbert_shards(_documents(s, d)),
        "op9_best_fit_packing": lambda s, d: packing.pack_documents(_documents(s, d)),
        "op10_importance_resampling": lambda s, d: importance.importance(_documents(s, d), _table(s, d, "labels")),
    }


#: All pairs that share a shingle, and all that can be reached from a document over linked ones.
NGRAM_JOIN = rf"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
  u AS (SELECT r, len(s) AS n, unnest(s) AS g FROM s),
  p AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
  reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
  c AS (SELECT reach.a AS r, min(s.doc_id) AS component_id FROM reach JOIN s ON reach.b = s.r GROUP BY reach.a)
  SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY s.s) END AS class_id FROM s JOIN c ON s.r = c.r"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": NGRAM_JOIN}

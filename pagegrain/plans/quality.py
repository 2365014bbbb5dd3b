"""Queries that judge recognised pages and candidate payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from ..sources.tables import BOXES, boxes, table
from .catalog import query


@query("q_true_median", f"WITH {BOXES} SELECT page, median(y1 - y0)::DOUBLE AS median FROM boxes GROUP BY page")
def _true_median(s, d):
    return quality.true_median(boxes(s, d).withColumn("h", F.col("y1") - F.col("y0")), "page", "h")


@query("q_fragmented", f"""WITH {BOXES}, w AS (SELECT page, x1 - x0 AS w, y1 - y0 AS h, row_number() OVER (PARTITION BY page ORDER BY x1 - x0) AS kw, row_number() OVER (PARTITION BY page ORDER BY y1 - y0) AS kh, count(*) OVER (PARTITION BY page) AS n FROM boxes),
  m AS (SELECT page, max(n) AS n, max(w) FILTER (kw = n // 2 + 1) AS width, max(h) FILTER (kh = n // 2 + 1) AS height FROM w GROUP BY page) SELECT page, n, width, height FROM m WHERE n >= 50 AND width <= greatest(0.1::DOUBLE * 960, 4.2::DOUBLE * height)""")
def _fragmented(s, d):
    return quality.fragmented(boxes(s, d), 960, least=50, share=0.1, heights=4.2)


SPARSE = f"""{BOXES}, i AS (SELECT page * 10 + pos // 8 AS page, x0 // 3 AS x0, y0, x0 // 3 + 4 * (x1 - x0) AS x1, y1, CASE WHEN pos % 31 = 0 THEN 0 ELSE 18 + pos % 22 END AS length FROM boxes), v AS (SELECT *, greatest(1, x1 - x0) AS w, greatest(1, y1 - y0) AS h FROM i WHERE length > 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY h) AS k, count(*) OVER (PARTITION BY page) AS n FROM v), m AS (SELECT page, greatest(8.0::DOUBLE, max(h) FILTER (k = n // 2 + 1)) AS median FROM k GROUP BY page)"""


@query("q_sparse_layout", f"""WITH {SPARSE}, c AS (SELECT v.page, count(*) AS items, count(*) FILTER (h >= greatest(1.7::DOUBLE * median, 0.075::DOUBLE * 540) OR (w >= 0.22::DOUBLE * 960 AND length >= 20)) AS large, count(*) FILTER (w <= 0.18::DOUBLE * 960 AND h <= 0.08::DOUBLE * 540 AND length <= 24) AS small, count(*) FILTER ((x0 + x1) / 2 >= 0.58::DOUBLE * 960) AS "right" FROM v JOIN m ON v.page = m.page GROUP BY v.page)
  SELECT * FROM c WHERE items BETWEEN 4 AND 18 AND large >= greatest(4, items - 2) AND small <= 1 AND "right" <= 1""")
def _sparse(s, d):
    b = boxes(s, d)
    left = F.expr("x0 div 3")
    items = b.select((F.col("page") * 10 + F.expr("pos div 8")).alias("page"), left.alias("x0"), "y0", (left + 4 * (F.col("x1") - F.col("x0"))).alias("x1"), "y1", F.when(F.col("pos") % 31 == 0, 0).otherwise(18 + F.col("pos") % 22).alias("length"))
    return quality.sparse_layout(items, 960, 540)


ITEMS = """i AS (SELECT doc_id % 40 AS candidate, doc_id % 7 = 0 AS image, CASE WHEN doc_id % 11 = 0 THEN '' ELSE left(text, CAST(doc_id * 37 % 700 AS INT)) END AS text, CASE WHEN doc_id % 2 = 0 THEN 'p.png' END AS path, CASE WHEN doc_id % 13 <> 0 THEN doc_id % 50 END AS y0, doc_id % 50 + doc_id * 31 % 140 - doc_id % 40 * 2 AS y1 FROM documents),
  p AS (SELECT *, length(trim(replace(text, chr(10), ''), ' ')) AS n, abs(y1 - y0) AS h FROM i),
  s AS (SELECT candidate, count(*) AS usable, CAST(sum(CASE WHEN NOT image AND coalesce(text <> '', false) THEN 4 + CASE WHEN n <= 100 THEN 1 WHEN n >= 500 THEN -2 WHEN n >= 240 THEN -1 ELSE 0 END + CASE WHEN h <= 30 THEN 2 WHEN h <= 55 THEN 1 WHEN h >= 110 THEN -2 WHEN h >= 75 THEN -1 ELSE 0 END WHEN image THEN CASE WHEN path IS NOT NULL THEN 3 ELSE 2 END ELSE 1 END) AS BIGINT) AS score FROM p WHERE y0 IS NOT NULL AND y1 IS NOT NULL GROUP BY candidate)"""


def _items(s, d):
    n = F.col("doc_id")
    text = F.when(n % 11 == 0, "").otherwise(F.left("text", (n * 37 % 700).cast("int")))
    return table(s, d, "documents").select((n % 40).alias("candidate"), (n % 7 == 0).alias("image"), text.alias("text"), F.when(n % 2 == 0, "p.png").alias("path"), F.when(n % 13 != 0, n % 50).alias("y0"), (n % 50 + n * 31 % 140 - n % 40 * 2).alias("y1"))


@query("q_content_scores", f"WITH {ITEMS} SELECT candidate, usable, score FROM s")
def _scores(s, d):
    return quality.content_scores(_items(s, d))


@query("q_prefer_layout", f"""WITH {ITEMS}, t AS (SELECT candidate, h::DOUBLE AS h, row_number() OVER (PARTITION BY candidate ORDER BY h) AS k, count(*) OVER (PARTITION BY candidate) AS n FROM p WHERE NOT image AND text <> '' AND y0 IS NOT NULL AND h > 0),
  q AS (SELECT candidate, max(h) FILTER (k = n // 2 + 1) AS median, max(h) FILTER (k = CAST(round_even((n - 1) * 0.9::DOUBLE, 0) AS BIGINT) + 1) AS p90 FROM t GROUP BY candidate), a AS (SELECT s.candidate, usable, score, median, p90 FROM s LEFT JOIN q ON s.candidate = q.candidate),
  e AS (SELECT x.candidate AS content, y.candidate AS layout, x.usable AS cu, x.score AS cs, y.usable AS lu, y.score AS ls, x.median AS cm, x.p90 AS cp, y.median AS lm, y.p90 AS lp FROM (SELECT DISTINCT candidate FROM i) c JOIN a x ON x.candidate = c.candidate JOIN a y ON y.candidate = (x.candidate * 7 + 3) % 40)
  SELECT content, layout, coalesce(lu > cu OR (lu = cu AND ls > cs) OR (cs - ls <= 8 AND cu - lu <= 2 AND greatest(1, lm) <= 0.82::DOUBLE * greatest(1, cm) AND greatest(1, lp) <= 0.88::DOUBLE * greatest(1, cp)), false) AS prefers_layout FROM e""")
def _prefer(s, d):
    items = _items(s, d)
    pairs = items.select(F.col("candidate").alias("content")).distinct().withColumn("layout", (F.col("content") * 7 + 3) % 40)
    return quality.prefer_layout(pairs, items).select("content", "layout", "prefers_layout")


@query("q_needs_tables", f"""WITH {BOXES}, e AS (SELECT page, CASE WHEN confidence = 0 AND pos % 50 = 1 THEN 'table' ELSE 'text' END AS type, CASE WHEN provider = 'A' THEN 'ocr' ELSE 'pdf' END AS source, CASE page % 3 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS layer FROM boxes),
  c AS (SELECT page, count(*) FILTER (type = 'text') AS texts, count(*) FILTER (type = 'text' AND source = 'ocr') AS recognised, bool_or(type = 'table') AS tables, bool_or(coalesce(layer, false)) AS layer FROM e GROUP BY page) SELECT page, texts, recognised FROM c WHERE NOT tables AND NOT layer AND (recognised >= 12 OR texts >= 30)""")
def _needs(s, d):
    e = boxes(s, d).select("page", F.when((F.col("confidence") == 0) & (F.col("pos") % 50 == 1), "table").otherwise("text").alias("type"), F.when(F.col("provider") == "A", "ocr").otherwise("pdf").alias("source"), F.when(F.col("page") % 3 != 0, F.col("page") % 3 == 2).alias("has_text_layer"))
    return quality.needs_tables(e)


ORDERS = [(1, "[2, 0, 1]", 3), (2, "[0, 0, 1]", 3), (3, "[3]", 3), (4, "[]", 3), (5, None, 3), (6, "[1]", 3), (7, "[-1]", 2), (8, '["1"]', 3), (9, "[true]", 3), (10, "[1.5]", 3), (11, '{"a": 1}', 3), (12, "no", 3)]
ORDER_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in ORDERS)


@query("q_reading_orders", f"""WITH v(id, t, n) AS (VALUES {ORDER_ROWS}), j AS (SELECT id, n, CASE WHEN json_valid(t) AND json_type(t) = 'ARRAY' THEN json_extract(t, '$[*]') END AS l FROM v), k AS (SELECT id, n, l, list_transform(l, lambda x: TRY_CAST(x AS BIGINT)) AS b, coalesce(list_bool_and(list_transform(l, lambda x: json_type(x) IN ('UBIGINT', 'BIGINT'))), true) AS whole FROM j)
  SELECT id::BIGINT AS id, CASE WHEN l IS NOT NULL AND whole AND coalesce(list_bool_and(list_transform(b, lambda x: x >= 0 AND x < n)), true) AND len(list_distinct(b)) = len(b) THEN array_to_string(b, ',') END AS reading FROM k""")
def _orders(s, d):
    rows = s.createDataFrame(ORDERS, "id long, t string, n long")
    return rows.select("id", F.array_join(quality.reading_order(F.col("t"), F.col("n")).cast("array<string>"), ",").alias("reading"))


GRIDS = [(1, '[{"bbox": [0, 1.5, 10, 20], "rows": 2, "cols": 3}, {"bbox": [1, 2, 3], "rows": 2, "cols": 3}, 7, {"bbox": [1, 2, 3, 4], "rows": 0, "cols": 3}]'), (2, "{}"), (3, None), (4, '[{"bbox": [1, 2, 3, "4"], "rows": 2, "cols": 2}, {"bbox": [-1, -2, 3, 4], "rows": 1, "cols": 1}, {"bbox": [1, 2, 3, 4], "rows": 1.5, "cols": 1}, {"rows": 1, "cols": 1}]')]
GRID_ROWS = ", ".join(f"({i}, " + ("NULL" if t is None else f"'{t}'") + ")" for i, t in GRIDS)


@query("q_table_grids", f"""WITH v(id, t) AS (VALUES {GRID_ROWS}), u AS (SELECT id, unnest(json_extract(t, '$[*]')) AS g, generate_subscripts(json_extract(t, '$[*]'), 1) - 1 AS pos FROM v WHERE json_type(t) = 'ARRAY')
  SELECT id::BIGINT AS id, pos, CAST(json_extract(g, '$.bbox[0]') AS DOUBLE) AS x0, CAST(json_extract(g, '$.bbox[3]') AS DOUBLE) AS y1, CAST(json_extract(g, '$.rows') AS BIGINT) AS rows, CAST(json_extract(g, '$.cols') AS BIGINT) AS cols FROM u
  WHERE json_array_length(g, '$.bbox') = 4 AND list_bool_and(list_transform(json_extract(g, '$.bbox[*]'), lambda x: json_type(x) IN ('UBIGINT', 'BIGINT', 'DOUBLE'))) AND json_type(g, '$.rows') IN ('UBIGINT', 'BIGINT') AND json_type(g, '$.cols') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract(g, '$.rows') AS DOUBLE) > 0 AND CAST(json_extract(g, '$.cols') AS DOUBLE) > 0""")
def _grids(s, d):
    out = quality.table_grids(s.createDataFrame(GRIDS, "id long, t string"), "t")
    return out.select("id", F.col("pos").cast("long").alias("pos"), F.element_at("bbox", 1).alias("x0"), F.element_at("bbox", 4).alias("y1"), "rows", "cols")


WORDS = f"""{BOXES}, w AS (SELECT page, pos, CASE WHEN pos % 10 = 0 THEN '  ' ELSE 'w' || pos END AS text, CASE WHEN pos % 9 = 0 THEN -1 ELSE confidence * 10 END AS conf, x0, y0, x1, y1, pos % 2 AS block, pos % 3 AS par, pos % 5 AS line FROM boxes), k AS (SELECT * FROM w WHERE conf >= 20 AND trim(text) <> '')"""


def _words(s, d, least=20.0):
    text = F.when(F.col("pos") % 10 == 0, "  ").otherwise(F.concat(F.lit("w"), F.col("pos").cast("string")))
    conf = F.when(F.col("pos") % 9 == 0, "none").otherwise((F.col("confidence") * 10).cast("string"))
    row = F.struct("pos", text.alias("text"), conf.alias("conf"), F.col("x0").alias("left"), F.col("y0").alias("top"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), (F.col("pos") % 2).alias("block"), (F.col("pos") % 3).alias("par"), (F.col("pos") % 5).alias("line"))
    rows = boxes(s, d).groupBy("page").agg(F.sort_array(F.collect_list(row)).alias("r"))
    lists = rows.select("page", *[F.col(f"r.{c}").alias(c) for c in ("text", "conf", "left", "top", "width", "height", "block", "par", "line")])
    return quality.recognised_words(lists, least)


@query("q_recognised_words", f"WITH {WORDS} SELECT page, pos - 1 AS pos, text, conf / 100.0::DOUBLE AS confidence, x0, y0, x1, y1 FROM k")
def _recognised(s, d):
    return _words(s, d).select("page", F.col("pos").cast("long").alias("pos"), "text", "confidence", "x0", "y0", "x1", "y1")


@query("q_word_stats", f"WITH {WORDS} SELECT page, count(*) AS words, count(DISTINCT (block, par, line)) AS lines, round(avg(conf), 6) AS confidence FROM k GROUP BY page")
def _word_stats(s, d):
    return quality.word_stats(_words(s, d), "page").withColumn("confidence", F.round("confidence", 6))


@query("q_best_pass", f"""WITH {WORDS}, p AS (SELECT page, 0 AS pass, 10 * count(DISTINCT (block, par, line)) + count(*) AS score FROM k GROUP BY page UNION ALL SELECT page, 1, 10 * count(DISTINCT (block, par, line)) + count(*) FROM w WHERE conf >= 5 AND trim(text) <> '' AND pos < 30 GROUP BY page)
  SELECT page, arg_min(pass, (-score, pass))::BIGINT AS pass, max(score) AS score FROM p GROUP BY page""")
def _best_pass(s, d):
    first = quality.word_stats(_words(s, d), "page").withColumn("pass", F.lit(0))
    second = quality.word_stats(_words(s, d, 5.0).where("pos < 29"), "page").withColumn("pass", F.lit(1))
    return quality.best_pass(first.unionByName(second)).withColumn("pass", F.col("pass").cast("long"))


@query("q_structural_lines", f"WITH {WORDS}, l AS (SELECT page, block, par, line, count(*) AS n, min(pos) AS first FROM k GROUP BY ALL) SELECT page, block, par, line, n, row_number() OVER (PARTITION BY page ORDER BY first) AS number FROM l")
def _structural(s, d):
    return quality.structural_lines(_words(s, d))


@query("q_char_frequency", r"WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM c WHERE NOT regexp_matches(c, '^\s$') AND c <> '' GROUP BY ALL) SELECT doc_id, count(*) AS different, max(n) AS most FROM n GROUP BY doc_id")
def _chars(s, d):
    return quality.char_frequencies(table(s, d, "documents"), "doc_id")


@query("q_text_colours", f"""WITH {BOXES}, c AS (SELECT page, pos, confidence AS contrast, x0 AS distance, y0 % 256 AS luma, page * 7 % 256 AS ground FROM boxes), k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY contrast DESC, distance DESC, pos) AS place, count(*) OVER (PARTITION BY page) AS n FROM c),
  t AS (SELECT *, CASE WHEN ground >= 128 THEN luma <= ground - 6 ELSE luma >= ground + 6 END AS off FROM k WHERE place <= CASE WHEN n >= 12 THEN greatest(6, least(96, n // 4)) ELSE n END), u AS (SELECT *, bool_or(off) OVER (PARTITION BY page) AS any_off FROM t),
  r AS (SELECT page, pos, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN ground >= 128 THEN luma ELSE -luma END, place) AS rank FROM u WHERE off OR NOT any_off) SELECT page, pos, rank FROM r WHERE rank <= 24""")
def _colours(s, d):
    samples = boxes(s, d).select("page", "pos", F.col("confidence").alias("contrast"), F.col("x0").alias("distance"), (F.col("y0") % 256).alias("luma"), (F.col("page") * 7 % 256).alias("ground"))
    return quality.text_colours(samples, "ground")

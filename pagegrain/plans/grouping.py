"""Queries on tokens in pairs, bands, table sizes, overlays, shifts, footers and damaged payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kinds, recovery
from ..operators import grouping
from ..sources.tables import BOXES, EVENTS, REGIONS, boxes, job_events, regions
from .catalog import query


@query("q_token_pairs", f"""WITH RECURSIVE {EVENTS}, k AS (SELECT job, event_id, CASE status WHEN 'click' THEN 'ref' WHEN 'view' THEN 'det' END AS kind, ts FROM ev), t AS (SELECT job, event_id, kind, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS k FROM k WHERE kind IS NOT NULL),
  f AS (SELECT job, k, event_id, kind, NULL::BIGINT AS first, NULL::BIGINT AS second, true AS open FROM t WHERE k = 1
    UNION ALL SELECT t.job, t.k, t.event_id, t.kind, CASE WHEN f.open AND f.kind <> t.kind THEN f.event_id END, CASE WHEN f.open AND f.kind <> t.kind THEN t.event_id END, NOT (f.open AND f.kind <> t.kind) FROM f JOIN t ON t.job = f.job AND t.k = f.k + 1)
  SELECT job, first, second FROM f WHERE first IS NOT NULL""")
def _pairs(s, d):
    kind = F.when(F.col("status") == "click", "ref").when(F.col("status") == "view", "det")
    return grouping.token_pairs(job_events(s, d).withColumn("kind", kind), "job", ("ts", "event_id"), "kind", "event_id")


@query("q_bands", f"""WITH RECURSIVE {BOXES}, k AS (SELECT page, pos, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, (y0 + y1) / 2.0::DOUBLE AS c, (14 + page % 5)::DOUBLE AS m, row_number() OVER (PARTITION BY page ORDER BY (y0 + y1) / 2.0::DOUBLE, x0, pos) AS k FROM boxes),
  f AS (SELECT page, pos, k, x0, y0, x1, y1, c AS mean, 1.0::DOUBLE AS n, 0::BIGINT AS band FROM k WHERE k = 1
    UNION ALL SELECT page, pos, k, CASE WHEN same THEN least(ax0, x0) ELSE x0 END, CASE WHEN same THEN least(ay0, y0) ELSE y0 END, CASE WHEN same THEN greatest(ax1, x1) ELSE x1 END, CASE WHEN same THEN greatest(ay1, y1) ELSE y1 END,
      CASE WHEN same THEN (mean * n + c) / (n + 1) ELSE c END, CASE WHEN same THEN n + 1 ELSE 1 END, band + (NOT same)::BIGINT
      FROM (SELECT k.*, f.x0 AS ax0, f.y0 AS ay0, f.x1 AS ax1, f.y1 AS ay1, f.mean, f.n, f.band, greatest(f.x0 - k.x1, k.x0 - f.x1, 0) <= greatest(38.4::DOUBLE, 6 * k.m) AND (abs(k.c - f.mean) <= 0.55::DOUBLE * k.m
        OR least(k.y1, f.y1) - greatest(k.y0, f.y0) >= 0.35::DOUBLE * least(greatest(1, f.y1 - f.y0), greatest(1, k.y1 - k.y0))) AS same FROM f JOIN k ON k.page = f.page AND k.k = f.k + 1))
  SELECT page, pos, band FROM f""")
def _bands(s, d):
    return grouping.bands(boxes(s, d).withColumn("median", 14 + F.col("page") % 5), 960.0)


@query("q_table_sizes", f"""WITH {BOXES}, c AS (SELECT page, pos % 7 - 1 AS r, pos // 7 % 6 AS c, CASE WHEN page % 11 = 0 THEN 0 ELSE x1 - x0 END AS w, y1 - y0 AS h FROM boxes), g AS (SELECT page, 'col' AS axis, unnest(range(4)) AS place FROM (SELECT DISTINCT page FROM c) UNION ALL SELECT page, 'row', unnest(range(5)) FROM (SELECT DISTINCT page FROM c)),
  i AS (SELECT * FROM c WHERE r BETWEEN 0 AND 4 AND c BETWEEN 0 AND 3), m AS (SELECT page, 'col' AS axis, c AS place, max(w) AS size FROM i GROUP BY ALL UNION ALL SELECT page, 'row', r, max(h) FROM i GROUP BY ALL),
  j AS (SELECT g.*, coalesce(size, 0)::DOUBLE AS size FROM g LEFT JOIN m USING (page, axis, place)), w AS (SELECT *, sum(size) OVER (PARTITION BY page, axis) AS whole FROM j),
  e AS (SELECT page, axis, place, CAST(round_even(CASE WHEN whole > 0 THEN size WHEN axis = 'col' THEN 960 / 4.0::DOUBLE ELSE 540 / 5.0::DOUBLE END * 12700 * 0.83::DOUBLE, 0) AS BIGINT) AS emu FROM w)
  SELECT page, axis, place, greatest(0, emu + CASE WHEN place = CASE axis WHEN 'col' THEN 3 ELSE 4 END THEN CASE axis WHEN 'col' THEN 4000000 + page ELSE 2000000 - page END - CAST(sum(emu) OVER (PARTITION BY page, axis) AS BIGINT) ELSE 0 END) AS emu FROM e""")
def _sizes(s, d):
    cells = boxes(s, d).withColumns({"r": F.col("pos") % 7 - 1, "c": F.expr("pos div 7 % 6"), "x1": F.when(F.col("page") % 11 == 0, F.col("x0")).otherwise(F.col("x1"))})
    return grouping.table_sizes(cells, "page", 5, 4, 960.0, 540.0, 4_000_000 + F.col("page"), 2_000_000 - F.col("page"), 0.83)


@query("q_overlay_stats", f"""WITH {BOXES}, p AS (SELECT page, confidence::DOUBLE AS std, CAST(round_even((x0 - 100) * 1.31::DOUBLE, 0) AS BIGINT) AS a, CAST(round_even(y0 * 1.17::DOUBLE, 0) AS BIGINT) AS b, CAST(round_even((x1 - 100) * 1.31::DOUBLE, 0) AS BIGINT) AS c, CAST(round_even(y1 * 1.17::DOUBLE, 0) AS BIGINT) AS d FROM boxes),
  v AS (SELECT *, a < 0 OR b < 0 OR c > 1000 OR d > 640 AS out, least(1000, greatest(0, c)) > greatest(0, least(999, a)) AND least(640, greatest(0, d)) > greatest(0, least(639, b)) AS drawn FROM p),
  r AS (SELECT *, row_number() OVER (PARTITION BY page, drawn ORDER BY std) AS k, count(*) OVER (PARTITION BY page, drawn) AS n FROM v)
  SELECT page, count(*) FILTER (out) AS outside, count(*) FILTER (drawn AND std <= 5) AS flat, max(std) FILTER (drawn AND k = n // 2 + 1) AS median_std FROM r GROUP BY page""")
def _overlay(s, d):
    moved = boxes(s, d).withColumns({"x0": F.col("x0") - 100, "x1": F.col("x1") - 100, "std": F.col("confidence")})
    return grouping.overlay_stats(moved, "page", 1000, 640, 1.31, 1.17)


_ITEMS = "items AS (SELECT page // 8 AS doc, page % 8 + page // 8 % 4 - 1 AS page, region FROM regions), sizes AS (SELECT DISTINCT page // 8 AS doc, page % 8 AS page FROM regions WHERE page % 3 <> 2), ranges AS (SELECT DISTINCT page // 8 AS doc, page // 8 % 6 + 1 AS \"start\", CASE WHEN page // 8 % 5 > 0 THEN page // 8 % 6 + 4 END AS \"end\" FROM regions)"


@query("q_content_shift", f"""WITH {REGIONS}, {_ITEMS}, c AS (SELECT DISTINCT i.doc, v.shift, CASE WHEN "end" IS NOT NULL THEN "start" - 1 END AS a, "end" - 1 AS b FROM items i JOIN ranges r ON r.doc = i.doc, LATERAL (SELECT unnest([0, -1, 1, "start" - 1, "start" - 2]) AS shift, unnest([true, true, true, "end" IS NOT NULL, "end" IS NOT NULL]) AS use) v WHERE use),
  h AS (SELECT c.doc, c.shift, count(*) FILTER (i.page + c.shift BETWEEN c.a AND c.b) AS x, count(*) FILTER (z.page IS NOT NULL) AS y, count(*) FILTER (i.page + c.shift >= 0) AS n FROM c JOIN items i ON i.doc = c.doc LEFT JOIN sizes z ON z.doc = c.doc AND z.page = i.page + c.shift GROUP BY c.doc, c.shift)
  SELECT doc, shift FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY x DESC, y DESC, n DESC, shift = 0 DESC, abs(shift), shift) AS k FROM h) WHERE k = 1""")
def _content_shift(s, d):
    doc = F.expr("page div 8").alias("doc")
    r = regions(s, d)
    items = r.select(doc, (F.col("page") % 8 + F.expr("page div 8 % 4") - 1).alias("page"))
    sizes = r.where("page % 3 <> 2").select(doc, (F.col("page") % 8).alias("page"))
    ranges = r.select(doc).distinct().select("doc", (F.col("doc") % 6 + 1).alias("start"), F.when(F.col("doc") % 5 > 0, F.col("doc") % 6 + 4).alias("end"))
    return grouping.content_shift(items, sizes, ranges)


_FOOTER = "CASE provider WHEN 'A' THEN 'Made with Brand-Name' WHEN 'N' THEN 'brandNAME 2026' WHEN 'R' THEN 'brandname and many other words that follow' END"


@query("q_footer_marks", f"""WITH {BOXES}, t AS (SELECT *, regexp_replace(lower({_FOOTER}), '[^a-z0-9]', '', 'g') AS packed FROM boxes)
  SELECT page, pos FROM t WHERE packed LIKE '%brandname%' AND length(replace(packed, 'brandname', '')) <= 24 AND (x1 - x0) / 960.0::DOUBLE <= 0.22::DOUBLE AND (y1 - y0) / 700.0::DOUBLE <= 0.08::DOUBLE AND (y0 + y1) / 2.0::DOUBLE >= 0.84::DOUBLE * 700 AND (x0 + x1) / 2.0::DOUBLE >= 0.72::DOUBLE * 960""")
def _footers(s, d):
    mark = kinds.footer_mark(F.expr(_FOOTER), F.struct("x0", "y0", "x1", "y1"), 960.0, 700.0, "brandname")
    return boxes(s, d).where(mark).select("page", "pos")


@query("q_recovered_items", f"""WITH {BOXES}, i AS (SELECT page, pos, '{{"text":"' || pos || '","bbox":[' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || ']}}' AS item FROM boxes), e AS (SELECT page, pos, sum(length(item) + 1) OVER (PARTITION BY page ORDER BY pos) AS ends, page * 37 % 900 + 1 AS cut FROM i)
  SELECT page, CAST(count(*) FILTER (ends <= cut) AS INT) AS n FROM e GROUP BY page""")
def _recovered(s, d):
    item = F.format_string('{"text":"%d","bbox":[%d,%d,%d,%d]}', "pos", "x0", "y0", "x1", "y1")
    listed = boxes(s, d).select("page", F.struct("pos", item.alias("item")).alias("i")).groupBy("page").agg(F.sort_array(F.collect_list("i")).alias("s"))
    payload = F.concat(F.lit("["), F.array_join(F.col("s.item"), ","), F.lit("]"))
    # the text breaks off after so many characters
    cut = listed.select("page", F.left(payload, (F.col("page") * 37 % 900 + 1).cast("int")).alias("text"))
    return cut.select("page", F.coalesce(F.size(recovery.recovered("text")), F.lit(0)).alias("n"))

"""Queries over boxes: forms of boxes, lines of a page, alignment of pages, queues and life spans of jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import alignment, events, layout, lines
from ..sources.tables import BOXES, EVENTS, REGIONS, boxes, job_events, regions
from .catalog import query

#: SQL of two boxes' agreement, a kept and b new.
INTER = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@query("q_parse_box", f"""WITH {BOXES} SELECT page, pos, CASE WHEN pos % 8 < 6 THEN x0::DOUBLE END AS x0, CASE WHEN pos % 8 < 6 THEN y0::DOUBLE END AS y0, CASE WHEN pos % 8 < 6 THEN x1::DOUBLE END AS x1, CASE WHEN pos % 8 < 6 THEN y1::DOUBLE END AS y1 FROM boxes""")
def _parse(s, d):
    """Boxes written as JSON in every form and two that are none, then read back."""
    forms = (
        "'[%4$d, %3$d, %2$d, %1$d]', y0, x0, y1, x1",
        "'{\"left\": %d, \"top\": %d, \"width\": %d, \"height\": %d}', x0, y0, x1 - x0, y1 - y0",
        "'{\"xmin\": %d, \"ymin\": %d, \"xmax\": %d, \"ymax\": %d}', x0, y0, x1, y1",
        "'[{\"x\": %d, \"y\": %d}, {\"left\": %d, \"top\": %d}]', x0, y0, x1, y1",
        "'[[%d, %d], [%d, %d]]', x1, y0, x0, y1",
        "'[%1$d, %2$d, %3$d, %2$d, %3$d, %4$d, %1$d, %4$d]', x0, y0, x1, y1",
        "'{\"left\": %d, \"top\": %d}', x0, y0",
        "'[%d, %d, null, \"x\"]', x0, y0",
    )
    text = F.expr("case pos % 8 " + " ".join(f"when {i} then format_string({f})" for i, f in enumerate(forms)) + " end")
    return boxes(s, d).select("page", "pos", shapes.parse_box(text).alias("b")).select("page", "pos", "b.x0", "b.y0", "b.x1", "b.y1")


_SCALED = "s AS (SELECT page, pos, x0 * (1 + pos % 3)::DOUBLE AS x0, y0 * (1 + pos % 3)::DOUBLE AS y0, x1 * (1 + pos % 3)::DOUBLE AS x1, y1 * (1 + pos % 3)::DOUBLE AS y1 FROM boxes)"


@query("q_grid_to_page", f"""WITH {BOXES}, {_SCALED}, g AS (SELECT page, pos, greatest(x1, y1) <= 1100 AS grid, x0, y0, x1, y1 FROM s),
  p AS (SELECT page, pos, CASE WHEN grid THEN x0 / 1000.0::DOUBLE * 960.0::DOUBLE ELSE x0 END AS x0, CASE WHEN grid THEN y0 / 1000.0::DOUBLE * 540.0::DOUBLE ELSE y0 END AS y0, least(960.0::DOUBLE, CASE WHEN grid THEN x1 / 1000.0::DOUBLE * 960.0::DOUBLE ELSE x1 END) AS x1, least(540.0::DOUBLE, CASE WHEN grid THEN y1 / 1000.0::DOUBLE * 540.0::DOUBLE ELSE y1 END) AS y1 FROM g)
  SELECT page, pos, CASE WHEN x1 > x0 AND y1 > y0 THEN x0 END AS x0, CASE WHEN x1 > x0 AND y1 > y0 THEN y0 END AS y0, CASE WHEN x1 > x0 AND y1 > y0 THEN x1 END AS x1, CASE WHEN x1 > x0 AND y1 > y0 THEN y1 END AS y1 FROM p""")
def _grid_page(s, d):
    by = (1 + F.col("pos") % 3).cast("double")
    b = F.struct(*((F.col(n) * by).alias(n) for n in ("x0", "y0", "x1", "y1")))
    out = boxes(s, d).select("page", "pos", b.alias("b"))
    return out.select("page", "pos", shapes.grid_to_page(F.col("b"), F.lit(960.0), F.lit(540.0)).alias("b")).select("page", "pos", "b.x0", "b.y0", "b.x1", "b.y1")


@query("q_fit_to_page", f"""WITH {BOXES}, {_SCALED}, k AS (SELECT page, pos, CASE pos % 4 WHEN 0 THEN 1000.0::DOUBLE WHEN 1 THEN 1600.0::DOUBLE END AS pw, CASE pos % 4 WHEN 0 THEN 1000.0::DOUBLE WHEN 1 THEN 1200.0::DOUBLE END AS ph,
    CASE WHEN pos % 5 = 0 THEN x0 / 4096 ELSE x0 END AS x0, CASE WHEN pos % 5 = 0 THEN y0 / 4096 ELSE y0 END AS y0, CASE WHEN pos % 5 = 0 THEN x1 / 4096 ELSE x1 END AS x1, CASE WHEN pos % 5 = 0 THEN y1 / 4096 ELSE y1 END AS y1 FROM s),
  m AS (SELECT *, CASE WHEN greatest(x1, y1) <= 1.2 THEN 'fraction' WHEN pw IS NOT NULL AND ((pw <= 1100 AND greatest(x1, y1) <= 1100) OR (x1 <= pw * 1.05::DOUBLE AND y1 <= ph * 1.05::DOUBLE)) THEN 'payload' WHEN pw IS NOT NULL THEN 'own'
    WHEN x1 <= 960.0::DOUBLE * 1.05::DOUBLE AND y1 <= 540.0::DOUBLE * 1.05::DOUBLE THEN 'own' WHEN greatest(x1, y1) <= 1100 THEN 'grid' ELSE 'shrink' END AS how, least(960.0::DOUBLE / greatest(1.0, x1), 540.0::DOUBLE / greatest(1.0, y1)) AS f FROM k),
  p AS (SELECT page, pos, CASE how WHEN 'fraction' THEN x0 * 960 WHEN 'payload' THEN x0 / pw * 960 WHEN 'grid' THEN x0 / 1000 * 960 WHEN 'shrink' THEN x0 * f ELSE x0 END AS x0, CASE how WHEN 'fraction' THEN y0 * 540 WHEN 'payload' THEN y0 / ph * 540 WHEN 'grid' THEN y0 / 1000 * 540 WHEN 'shrink' THEN y0 * f ELSE y0 END AS y0,
    CASE how WHEN 'fraction' THEN x1 * 960 WHEN 'payload' THEN x1 / pw * 960 WHEN 'grid' THEN x1 / 1000 * 960 WHEN 'shrink' THEN x1 * f ELSE x1 END AS x1, CASE how WHEN 'fraction' THEN y1 * 540 WHEN 'payload' THEN y1 / ph * 540 WHEN 'grid' THEN y1 / 1000 * 540 WHEN 'shrink' THEN y1 * f ELSE y1 END AS y1 FROM m),
  c AS (SELECT page, pos, least(960::DOUBLE, x0) AS x0, least(540::DOUBLE, y0) AS y0, least(960::DOUBLE, x1) AS x1, least(540::DOUBLE, y1) AS y1 FROM p)
  SELECT page, pos, CASE WHEN x1 > x0 AND y1 > y0 THEN x0 END AS x0, CASE WHEN x1 > x0 AND y1 > y0 THEN y0 END AS y0, CASE WHEN x1 > x0 AND y1 > y0 THEN x1 END AS x1, CASE WHEN x1 > x0 AND y1 > y0 THEN y1 END AS y1 FROM c""")
def _fit_page(s, d):
    by = (1 + F.col("pos") % 3).cast("double") / F.when(F.col("pos") % 5 == 0, 4096).otherwise(1)
    b = F.struct(*((F.col(n) * by).alias(n) for n in ("x0", "y0", "x1", "y1")))
    width, height = (F.when(F.col("pos") % 4 == 0, 1000.0).when(F.col("pos") % 4 == 1, other) for other in (1600.0, 1200.0))
    out = boxes(s, d).select("page", "pos", b.alias("b"), width.alias("pw"), height.alias("ph"))
    return out.select("page", "pos", shapes.fit_to_page(F.col("b"), F.col("pw"), F.col("ph"), F.lit(960.0), F.lit(540.0)).alias("b")).select("page", "pos", "b.x0", "b.y0", "b.x1", "b.y1")


@query("q_polygons", f"""WITH {BOXES}, t AS (SELECT page, pos, x0, x1, [CAST(round_even(v * 0.37::DOUBLE * 10.0::DOUBLE, 0) AS BIGINT) FOR v IN [x0, x1]] AS xs, [CAST(round_even(v * 0.37::DOUBLE * 10.0::DOUBLE, 0) AS BIGINT) FOR v IN [y0, y1]] AS ys FROM boxes)
  SELECT page, pos, xs[1] || ',' || ys[1] || ';' || xs[2] || ',' || ys[1] || ';' || xs[2] || ',' || ys[2] || ';' || xs[1] || ',' || ys[2] AS sig, x0 = 0 AS fits FROM t""")
def _polygons(s, d):
    points = shapes.corners(F.struct("x0", "y0", "x1", "y1"))
    moved = F.struct((F.col("x0") + F.when(F.col("x0") == 0, 0).otherwise(2)).alias("x0"), "y0", "x1", "y1")
    return boxes(s, d).select("page", "pos", shapes.signature(shapes.scale_points(points, 0.37, 0.37)).alias("sig"), shapes.points_fit(points, moved).alias("fits"))


@query("q_erase_padding", f"WITH {BOXES} SELECT page, pos, greatest(1.0::DOUBLE, least(8.0::DOUBLE, (y1 - y0) * 0.35::DOUBLE)) AS pad_x, greatest(1.0::DOUBLE, least(4.4::DOUBLE, (y1 - y0) * 0.23::DOUBLE)) AS pad_y, abs((x0 + x1) * 0.5::DOUBLE - 500) <= 54 AND abs(x0 - (1000 - x1)) <= 70.00000000000001::DOUBLE AS centred FROM boxes")
def _padding(s, d):
    height = F.col("y1") - F.col("y0")
    return boxes(s, d).select("page", "pos", shapes.erase_padding(height)[0].alias("pad_x"), shapes.erase_padding(height, fill=True)[1].alias("pad_y"), shapes.centred(F.col("x0"), F.col("x1"), 1000.0).alias("centred"))


@query("q_y_lines", f"""WITH RECURSIVE {BOXES}, k AS (SELECT page, pos, (y0 + y1) / 2.0::DOUBLE AS c, row_number() OVER (PARTITION BY page ORDER BY (y0 + y1) / 2.0::DOUBLE, x0, pos) AS k FROM boxes),
  f AS (SELECT page, pos, k, c AS mean, 1.0::DOUBLE AS n, 0::BIGINT AS line FROM k WHERE k = 1 UNION ALL SELECT k.page, k.pos, k.k, CASE WHEN abs(k.c - f.mean) > 9 THEN k.c ELSE (f.mean * f.n + k.c) / (f.n + 1) END, CASE WHEN abs(k.c - f.mean) > 9 THEN 1 ELSE f.n + 1 END, f.line + (abs(k.c - f.mean) > 9)::BIGINT FROM f JOIN k ON k.page = f.page AND k.k = f.k + 1)
  SELECT page, pos, line FROM f""")
def _y_lines(s, d):
    return lines.y_lines(boxes(s, d), 9.0)


@query("q_box_components", f"""WITH RECURSIVE {BOXES}, e AS (SELECT a.page, a.pos AS a, b.pos AS b FROM boxes a JOIN boxes b ON a.page = b.page AND least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.4 * greatest(1, least(a.y1 - a.y0, b.y1 - b.y0)) AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 4),
  r AS (SELECT page, pos, pos AS root FROM boxes UNION SELECT e.page, e.b, r.root FROM r JOIN e ON e.page = r.page AND e.a = r.pos), m AS (SELECT page, pos, min(root) AS root FROM r GROUP BY page, pos)
  SELECT page, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1 FROM boxes JOIN m USING (page, pos) GROUP BY page, root""")
def _components(s, d):
    return lines.merged(boxes(s, d), 4.0, many=0)


@query("q_merge_boxes", None)
def _merge_boxes(s, d):
    return lines.merged(boxes(s, d), 4.0)


@query("q_coarse_pruned", f"""WITH {BOXES}, k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y1 - y0, pos) AS k, count(*) OVER (PARTITION BY page) AS n FROM boxes), m AS (SELECT *, max(CASE WHEN k = n // 2 + 1 THEN y1 - y0 END) OVER (PARTITION BY page) AS m FROM k)
  SELECT page, pos FROM m WHERE NOT (y1 - y0 >= greatest(3 * m, 0.14 * 100) AND x1 - x0 >= 0.2 * 200) AND NOT (x1 - x0 >= 0.9 * 200 AND y1 - y0 >= greatest(1.8 * m, 0.08 * 100))""")
def _coarse(s, d):
    return lines.coarse_pruned(boxes(s, d), 200, 100).select("page", "pos")


@query("q_split_rows", f"WITH {BOXES}, n AS (SELECT *, 1 + pos % 3 AS n FROM boxes), l AS (SELECT *, unnest(range(n)) AS line FROM n) SELECT page, pos, line, y0 + (y1 - y0) * line / n AS top, y0 + (y1 - y0) * (line + 1) / n AS bottom FROM l")
def _split(s, d):
    return lines.split_rows(boxes(s, d), 1 + F.col("pos") % 3).select("page", "pos", "line", "top", "bottom")


_PAGES = "own AS (SELECT page // 8 AS doc, page % 8 AS page, max(x1) AS width, max(y1) AS height FROM regions GROUP BY ALL), payload AS (SELECT doc, page + doc % 4 - 1 AS page, width * (1 + doc % 2) AS width, height + page % 2 AS height FROM own WHERE page <> 3)"


@query("q_page_shift", f"""WITH {REGIONS}, {_PAGES}, h AS (SELECT a.doc, b.page - a.page AS shift, a.width::DOUBLE AS aw, a.height::DOUBLE AS ah, b.width::DOUBLE AS bw, b.height::DOUBLE AS bh FROM payload a JOIN own b ON a.doc = b.doc),
  v AS (SELECT doc, shift, count(*) AS hits, sum((abs(aw / ah - bw / bh) <= 0.03::DOUBLE * greatest(aw / ah, bw / bh, 1))::BIGINT + (abs(aw / bw - ah / bh) <= 0.08::DOUBLE * greatest(aw / bw, ah / bh, 1))::BIGINT + (abs(aw - bw) <= 2 AND abs(ah - bh) <= 2)::BIGINT) AS score FROM h GROUP BY doc, shift),
  w AS (SELECT doc, shift, hits, score FROM v UNION ALL SELECT DISTINCT p.doc, z.shift, 0, 0 FROM payload p CROSS JOIN (SELECT unnest([-1, 0, 1])::BIGINT AS shift) z WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.doc = p.doc AND v.shift = z.shift)),
  c AS (SELECT p.doc, p.page, w.*, o.page IS NOT NULL AS there FROM payload p JOIN w ON w.doc = p.doc LEFT JOIN own o ON o.doc = p.doc AND o.page = p.page + w.shift),
  b AS (SELECT doc, page, shift, there, row_number() OVER (PARTITION BY doc, page ORDER BY hits DESC, score DESC, there DESC, (shift = 0) DESC, abs(shift), shift) AS k FROM c)
  SELECT b.doc, b.page, CASE WHEN there THEN b.page + shift WHEN o.page IS NOT NULL THEN b.page END AS target FROM b LEFT JOIN own o ON o.doc = b.doc AND o.page = b.page WHERE k = 1""")
def _shift(s, d):
    own = regions(s, d).groupBy(F.expr("page div 8").alias("doc"), (F.col("page") % 8).alias("page")).agg(F.max("x1").alias("width"), F.max("y1").alias("height"))
    payload = own.where("page <> 3").selectExpr("doc", "page + doc % 4 - 1 as page", "width * (1 + doc % 2) as width", "height + page % 2 as height")
    return alignment.page_shift(payload, own)


@query("q_queue_states", f"""WITH {EVENTS}, jobs AS (SELECT job, CASE arg_max(status, (ts, event_id)) WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status FROM ev WHERE job % 7 <> 0 GROUP BY job),
  places AS (SELECT e.job, row_number() OVER (PARTITION BY e.job % 4 ORDER BY e.event_id, e.job) AS place FROM ev e LEFT JOIN jobs j ON e.job = j.job WHERE e.status = 'click' AND e.progress < 2 AND (j.status IS NULL OR j.status IN ('pending', 'processing'))),
  p AS (SELECT job, max(place) AS position FROM places GROUP BY job), st AS (SELECT DISTINCT job FROM ev WHERE status = 'error' AND progress > 10)
  SELECT jobs.job, jobs.status, position, CASE WHEN position IS NOT NULL THEN 'queued' WHEN jobs.status = 'processing' OR st.job IS NOT NULL THEN 'running' WHEN jobs.status = 'pending' THEN 'waiting' ELSE 'done' END AS state FROM jobs LEFT JOIN p ON jobs.job = p.job LEFT JOIN st ON jobs.job = st.job""")
def _queue(s, d):
    ev = job_events(s, d)
    now = F.max_by("status", F.struct("ts", "event_id"))
    status = F.when(now == "click", "pending").when(now == "view", "processing").when(now == "error", "failed").otherwise("completed")
    jobs = ev.where("job % 7 <> 0").groupBy("job").agg(status.alias("status"))
    queued = ev.where("status = 'click' and progress < 2").selectExpr("job % 4 as queue", "event_id as at", "job")
    return alignment.queue_states(jobs, queued, ev.where("status = 'error' and progress > 10")).select("job", "status", "position", "state")


@query("q_alive", f"""WITH {EVENTS}, t AS (SELECT job, event_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY job ORDER BY ts, event_id) >= 43200000000 AS late FROM ev),
  g AS (SELECT job, us, CAST(sum(coalesce(late, false)::INT) OVER (PARTITION BY job ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS span FROM t) SELECT job, span, count(*) AS n, min(us) AS first, max(us) + 43200000000 AS expires FROM g GROUP BY job, span""")
def _alive(s, d):
    return events.alive(job_events(s, d), 43_200)


@query("q_deadline", f"WITH {EVENTS} SELECT job, event_id, spent FROM (SELECT job, event_id, CAST(coalesce(sum(progress) OVER (PARTITION BY job ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent FROM ev) WHERE spent < 40")
def _deadline(s, d):
    return events.before_deadline(job_events(s, d), "progress", 40).select("job", "event_id", "spent")

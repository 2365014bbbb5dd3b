"""Queries of page measures: maps between spaces, page predicates, colours and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as m
from ..operators import layout
from ..sources.tables import BOXES, REGIONS, boxes, regions, table
from .catalog import query


def _boxed(s, d):
    return boxes(s, d).withColumn("b", m.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


@query("q_pixel_boxes", f"""WITH {BOXES} SELECT page, pos, CASE WHEN bad THEN NULL ELSE x0::DOUBLE END AS x0, CASE WHEN bad THEN NULL ELSE y0::DOUBLE END AS y0, CASE WHEN bad THEN NULL ELSE x1::DOUBLE END AS x1,
  CASE WHEN bad THEN NULL WHEN pos % 7 = 0 THEN 1e9 ELSE y1::DOUBLE END AS y1 FROM (SELECT *, pos % 11 = 0 OR pos % 9 = 0 AS bad FROM boxes)""")
def _pixel_boxes(s, d):
    side = [F.col(c).cast("double") for c in ("x1", "y1", "x0", "y0")]
    odd = F.when(F.col("pos") % 11 == 0, F.array(*side[:3])).when(F.col("pos") % 9 == 0, F.array(side[0], F.lit(float("nan")), side[2], side[3]))
    given = odd.when(F.col("pos") % 7 == 0, F.array(side[0], F.lit(m.INFINITY), side[2], side[3])).otherwise(F.array(*side))
    out = boxes(s, d).select("page", "pos", m.pixel_box(given).alias("b"))
    return out.select("page", "pos", "b.x0", "b.y0", "b.x1", F.when(F.col("b").isNotNull(), F.least("b.y1", F.lit(1e9))).alias("y1"))


@query("q_points", f"""WITH {BOXES}, c AS (SELECT page, pos, least(greatest(x0::DOUBLE, 0), 799) AS a, least(greatest(y0::DOUBLE, 0), 599) AS b, least(greatest(x1::DOUBLE, 0), 800) AS c, least(greatest(y1::DOUBLE, 0), 600) AS d FROM boxes),
  k AS (SELECT *, c > a AND d > b AS ok, 960.0::DOUBLE / 800.0::DOUBLE AS sx, 540.0::DOUBLE / 600.0::DOUBLE AS sy FROM c)
  SELECT page, pos, CASE WHEN ok THEN a * sx END AS x0, CASE WHEN ok THEN b * sy END AS y0, CASE WHEN ok THEN c * sx END AS x1, CASE WHEN ok THEN d * sy END AS y1 FROM k""")
def _points(s, d):
    return _boxed(s, d).select("page", "pos", m.to_points(F.col("b"), 800, 600, 960.0, 540.0).alias("p")).select("page", "pos", "p.x0", "p.y0", "p.x1", "p.y1")


@query("q_pixel_rects", f"""WITH {BOXES}, c AS (SELECT page, pos, least(greatest(round_even(x0 * (800.0::DOUBLE / 960.0::DOUBLE), 0), 0), 799) AS a, least(greatest(round_even(y0 * (450.0::DOUBLE / 540.0::DOUBLE), 0), 0), 449) AS b,
  least(greatest(round_even(x1 * (800.0::DOUBLE / 960.0::DOUBLE), 0), 0), 800) AS c, least(greatest(round_even(y1 * (450.0::DOUBLE / 540.0::DOUBLE), 0), 0), 450) AS d FROM boxes)
  SELECT page, pos, CASE WHEN c > a AND d > b THEN a END AS x0, CASE WHEN c > a AND d > b THEN b END AS y0, CASE WHEN c > a AND d > b THEN c END AS x1, CASE WHEN c > a AND d > b THEN d END AS y1 FROM c""")
def _pixel_rects(s, d):
    return _boxed(s, d).select("page", "pos", m.to_pixel_box(F.col("b"), 960.0, 540.0, 800, 450).alias("p")).select("page", "pos", "p.x0", "p.y0", "p.x1", "p.y1")


@query("q_scaled", f"""WITH {BOXES}, c AS (SELECT *, 1 + (pos % 4) * 4e-7 AS sx, 1 + (pos % 3) * 4e-7 AS sy FROM boxes), k AS (SELECT *, abs(sx - 1) < 1e-6 AND abs(sy - 1) < 1e-6 AS same FROM c)
  SELECT page, pos, CASE WHEN same THEN x0 ELSE x0 * sx END::DOUBLE AS x0, CASE WHEN same THEN y0 ELSE y0 * sy END::DOUBLE AS y0, CASE WHEN same THEN x1 ELSE x1 * sx END::DOUBLE AS x1, CASE WHEN same THEN y1 ELSE y1 * sy END::DOUBLE AS y1 FROM k""")
def _scaled(s, d):
    sx, sy = F.lit(1) + (F.col("pos") % 4) * F.lit(4e-7), F.lit(1) + (F.col("pos") % 3) * F.lit(4e-7)
    return _boxed(s, d).select("page", "pos", m.scaled(F.col("b"), sx, sy).alias("p")).select("page", "pos", "p.x0", "p.y0", "p.x1", "p.y1")


@query("q_centre_distance", f"""WITH {BOXES} SELECT a.page, a.pos, sqrt(((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) * ((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) + ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) * ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2)) / sqrt(960.0::DOUBLE * 960 + 540.0::DOUBLE * 540) AS distance
  FROM boxes a JOIN boxes b ON a.page = b.page AND b.pos = a.pos + 1""")
def _distance(s, d):
    rows = _boxed(s, d).select("page", "pos", "b")
    both = rows.alias("a").join(rows.alias("n"), (F.col("a.page") == F.col("n.page")) & (F.col("n.pos") == F.col("a.pos") + 1))
    return both.select("a.page", "a.pos", m.centre_distance(F.col("a.b"), F.col("n.b"), 960.0, 540.0).alias("distance"))


@query("q_progress_span", f"""WITH {BOXES} SELECT page, pos, CASE WHEN pos % 12 - 1 <= 0 THEN 97 ELSE CAST(round_even(10 + 87 * least(greatest(confidence::DOUBLE / (pos % 12 - 1), 0), 1), 0) AS BIGINT) END AS progress FROM boxes""")
def _progress(s, d):
    return boxes(s, d).select("page", "pos", m.progress(F.col("confidence"), F.col("pos") % 12 - 1, 10, 97).alias("progress"))


@query("q_resized", f"""WITH {BOXES}, c AS (SELECT page, pos, x1, y1, 640.0::DOUBLE / least(x1, y1) AS short, 640.0::DOUBLE / greatest(x1, y1) AS long FROM boxes)
  SELECT page, pos, greatest(1, round_even(x1 * short, 0)) AS sw, greatest(1, round_even(y1 * short, 0)) AS sh, greatest(1, round_even(x1 * long, 0)) AS lw, greatest(1, round_even(y1 * long, 0)) AS lh FROM c""")
def _resized(s, d):
    out = boxes(s, d).select("page", "pos", m.resized(F.col("x1"), F.col("y1"), 640.0, "short").alias("s"), m.resized(F.col("x1"), F.col("y1"), 640.0).alias("l"))
    return out.select("page", "pos", F.col("s.width").alias("sw"), F.col("s.height").alias("sh"), F.col("l.width").alias("lw"), F.col("l.height").alias("lh"))


@query("q_pixel_budget", f"""WITH {BOXES}, c AS (SELECT page, pos, x1 * y1 AS n, 3 * x0 AS side, pos % 4 <> 0 AS shrunk FROM boxes)
  SELECT page, pos, greatest(101920, greatest(n, 101920) // 784 * 784) AS pixels, CASE WHEN shrunk AND side > 0 AND side < 2200 THEN greatest(101920, CAST(floor(1003520.0::DOUBLE * (side::DOUBLE / 2200) * (side::DOUBLE / 2200) / 784) AS BIGINT) * 784) END AS budget FROM c""")
def _budget(s, d):
    return boxes(s, d).select("page", "pos", m.quantised(F.col("x1") * F.col("y1")).alias("pixels"), m.pixel_budget(3 * F.col("x0"), F.col("pos") % 4 != 0).alias("budget"))


@query("q_slide_boxes", f"""WITH {BOXES}, f AS (SELECT *, least(9144000.0::DOUBLE / (960.0::DOUBLE * 12700), 5143500.0::DOUBLE / (720.0::DOUBLE * 12700)) AS k FROM boxes), g AS (SELECT *, (9144000 - 960.0::DOUBLE * 12700 * k) / 2 AS dx, (5143500 - 720.0::DOUBLE * 12700 * k) / 2 AS dy FROM f)
  SELECT page, pos, CAST(round_even(dx + x0::DOUBLE * 12700 * k, 0) AS BIGINT) AS "left", CAST(round_even(dy + y0::DOUBLE * 12700 * k, 0) AS BIGINT) AS top, greatest(0, CAST(round_even((x1 - x0)::DOUBLE * 12700 * k, 0) AS BIGINT)) AS width, greatest(0, CAST(round_even((y1 - y0)::DOUBLE * 12700 * k, 0) AS BIGINT)) AS height FROM g""")
def _slide_boxes(s, d):
    fit = m.fitted(F.lit(960.0), F.lit(720.0), 9144000, 5143500)
    return _boxed(s, d).select("page", "pos", m.on_slide(F.col("b"), fit).alias("e")).select("page", "pos", "e.left", "e.top", "e.width", "e.height")


@query("q_slide_type", """WITH r AS (SELECT o_orderkey AS id, 20 + o_custkey % 50 AS w, o_orderkey % 40 AS h FROM orders), k AS (SELECT *, CASE WHEN h > 0 THEN w::DOUBLE / h END AS ratio FROM r), a AS (SELECT *, abs(ratio - 4.0::DOUBLE / 3) AS a, abs(ratio - 1.6::DOUBLE) AS b, abs(ratio - 16.0::DOUBLE / 9) AS c FROM k)
  SELECT id, CASE WHEN h <= 0 THEN NULL WHEN least(a, b, c) > 0.08 THEN 'custom' WHEN a <= b AND a <= c THEN 'screen4x3' WHEN b <= c THEN 'screen16x10' ELSE 'screen16x9' END AS kind FROM a""")
def _slide(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), m.slide_kind(20 + F.col("o_custkey") % 50, F.col("o_orderkey") % 40).alias("kind"))


@query("q_near_full_page", f"""WITH {BOXES}, e AS (SELECT page, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1 FROM boxes GROUP BY page)
  SELECT page, (x1 - x0) * (y1 - y0) / 720000 AS share, x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) / 720000 >= 0.88 AND x0 <= 15 AND y0 <= 0.015::DOUBLE * 720 AND 1000 - x1 <= 15 AND 720 - y1 <= 0.015::DOUBLE * 720 AS full_page FROM e""")
def _full(s, d):
    e = layout.envelope(boxes(s, d), "page").withColumn("b", m.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    return e.select("page", m.area_ratio(F.col("b"), F.lit(1000), F.lit(720)).alias("share"), m.near_full_page(F.col("b"), F.lit(1000), F.lit(720)).alias("full_page"))


@query("q_suppress_box", f"""WITH {REGIONS}, p AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, region % 2 = 0 AS sure FROM regions), q AS (SELECT *, CASE WHEN sure THEN least(greatest(0.05::DOUBLE * w, 1.5), 8) ELSE least(greatest(0.02::DOUBLE * w, 0.8), 3.5) END AS px, CASE WHEN sure THEN least(greatest(0.07::DOUBLE * h, 1), 6) ELSE least(greatest(0.03::DOUBLE * h, 0.8), 3) END AS py FROM p)
  SELECT region, greatest(0, x0 - px) AS x0, greatest(0, y0 - py) AS y0, least(960, x1 + px) AS x1, least(720, y1 + py) AS y1 FROM q""")
def _suppress_box(s, d):
    b = m.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return regions(s, d).select("region", m.suppress_box(b, 960.0, 720.0, F.col("region") % 2 == 0).alias("p")).select("region", "p.x0", "p.y0", "p.x1", "p.y1")


@query("q_rgb", """WITH n AS (SELECT o_orderkey AS id, (o_orderkey * 7919) & 16777215 AS n, o_orderkey % 10 = 3 AS bad FROM orders), c AS (SELECT id, CASE WHEN NOT bad THEN n >> 16 END AS r, CASE WHEN NOT bad THEN (n >> 8) & 255 END AS g, CASE WHEN NOT bad THEN n & 255 END AS b FROM n),
  k AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS brightness FROM c)
  SELECT id, r, g, b, brightness, (r - 18) * (r - 18) + (g - 52) * (g - 52) + (b - 86) * (b - 86) AS away, CASE WHEN r IS NULL THEN NULL WHEN brightness >= 130 THEN '#000000' ELSE '#ffffff' END AS ink FROM k""")
def _rgb(s, d):
    text = F.lpad(F.hex((F.col("o_orderkey") * 7919).bitwiseAND(0xFFFFFF)), 6, "0")
    given = F.when(F.col("o_orderkey") % 10 == 3, F.substring(text, 1, 5)).when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" #"), text)).otherwise(text)
    out = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), m.rgb(given).alias("c"))
    point = F.struct(F.lit(18).alias("r"), F.lit(52).alias("g"), F.lit(86).alias("b"))
    long = [F.col(f"c.{n}").cast("long").alias(n) for n in "rgb"]
    return out.select("id", *long, m.brightness(F.col("c")).alias("brightness"), m.square_distance(F.col("c"), point).cast("long").alias("away"), F.when(F.col("c").isNotNull(), m.contrasting(F.col("c"))).alias("ink"))


COLOURS = ["#A1b2C3", "0xFF00aa", "abc", "#80112233", "12345", "", None, " #fff ", "zzzzzz", "0Xabc"]


@query("q_colour_texts", f"""WITH v AS (SELECT unnest(range(1, {len(COLOURS) + 1})) AS id, unnest([{", ".join("NULL" if c is None else f"'{c}'" for c in COLOURS)}]) AS t), a AS (SELECT id, regexp_replace(trim(t), '^(#|0[xX])', '') AS t FROM v), b AS (SELECT id, CASE WHEN length(t) = 8 THEN right(t, 6) ELSE t END AS t FROM a),
  c AS (SELECT id, CASE WHEN length(t) = 3 THEN regexp_replace(t, '(.)', '\\1\\1', 'g') ELSE t END AS t FROM b) SELECT id, CASE WHEN regexp_full_match(t, '[0-9a-fA-F]{{6}}') THEN '#' || lower(t) END AS colour FROM c""")
def _colour_texts(s, d):
    rows = s.createDataFrame(list(enumerate(COLOURS, 1)), "id long, t string")
    return rows.select("id", m.colour_text(F.col("t")).alias("colour"))


NUMBERS = ["12", "abc", None, "-5", "999999", "", "0", "77"]


@query("q_whole_numbers", f"WITH v AS (SELECT unnest(range(1, {len(NUMBERS) + 1})) AS id, unnest([{', '.join('NULL' if c is None else repr(c) for c in NUMBERS)}]) AS t) SELECT id, least(greatest(coalesce(TRY_CAST(t AS BIGINT), 7), 0), 500) AS n FROM v")
def _whole(s, d):
    rows = s.createDataFrame(list(enumerate(NUMBERS, 1)), "id long, t string")
    return rows.select("id", m.whole_or(F.col("t"), 7, 0, 500).alias("n"))

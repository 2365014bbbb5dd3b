"""Queries on widths, splits, probes, cards, outlines and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import outlines, settings, wrapping
from ..functions import text as txt
from ..operators import recognised
from ..sources.tables import BOXES, REGIONS, boxes, regions, table
from .catalog import query


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


_COUNTS = [(_count(pattern), share) for pattern, share in wrapping.WIDTHS]


@query("q_text_widths", f"SELECT doc_id, ({' + '.join(f'{c} * {share}::DOUBLE' for c, share in _COUNTS)} + (length(text) - {' - '.join(c for c, _ in _COUNTS)}) * {wrapping.OTHER}::DOUBLE) * 11 AS width FROM documents WHERE text IS NOT NULL")
def _widths(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", wrapping.text_width(F.col("text"), F.lit(11)).alias("width"))


@query("q_wrapped_lines", None)
def _wrapped(s, d):
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "t")).where(F.length(F.trim("t")) > 0)
    return lines.select("doc_id", "paragraph", F.posexplode(wrapping.wrapped(txt.wrap_tokens(F.trim("t")), F.lit(240.0), F.lit(11.0))).alias("line", "text"))


SPLITS = "s AS (SELECT *, repeat(CASE WHEN page % 3 = 0 THEN 'ab c' ELSE '数 x' END, CAST(pos % 23 AS INT)) AS text, CAST(page % 11 AS INT) AS cut, CAST(page % 5 AS INT) AS lost FROM boxes)"


@query("q_plausible_splits", f"""WITH {BOXES}, {SPLITS}, l AS (SELECT *, left(text, cut) AS a, substr(text, cut + 1 + lost) AS b FROM s), p AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS o, regexp_replace(a || b, '\\s+', '', 'g') AS j, length(regexp_replace(a, '\\s+', '', 'g')) AS la, length(regexp_replace(b, '\\s+', '', 'g')) AS lb, greatest(1.0::DOUBLE, x1 - x0) AS w, greatest(1.0::DOUBLE, y1 - y0) AS h FROM l),
  n AS (SELECT *, length(o) AS n, length(j) AS m, least(la, lb) AS low, greatest(la, lb) AS high FROM p)
  SELECT page, pos FROM n WHERE m > 0 AND (n = 0 OR (NOT ((contains(j, o) OR contains(o, j)) AND n <= 44 AND abs(n - m) >= 3) AND least(n, m)::DOUBLE / greatest(1, n, m) >= CASE WHEN n <= 36 THEN 0.62::DOUBLE WHEN n <= 64 THEN 0.56::DOUBLE ELSE 0.45::DOUBLE END AND NOT (low > 0 AND low <= 5 AND low < 0.30::DOUBLE * high AND w >= 0.25::DOUBLE * 400 AND h / w <= 0.12::DOUBLE)))""")
def _splits(s, d):
    rows = boxes(s, d).withColumn("text", F.expr("repeat(CASE WHEN page % 3 = 0 THEN 'ab c' ELSE '数 x' END, CAST(pos % 23 AS INT))"))
    lines = F.array(F.expr("left(text, int(page % 11))"), F.expr("substring(text, int(page % 11 + 1 + page % 5))"))
    kept = wrapping.plausible_split(F.col("text"), lines, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), 400.0)
    return rows.where(kept).select("page", "pos")


_TEXT = "CASE provider WHEN 'A' THEN repeat('Word 数 ', CAST(pos % 12 AS INT)) WHEN 'N' THEN repeat('数据说明', CAST(pos % 9 AS INT)) ELSE repeat('ab' || chr(10), CAST(pos % 4 AS INT)) END"


@query("q_probed_pages", f"""WITH {BOXES}, t AS (SELECT page, {_TEXT} AS text, x1 - x0 AS w, greatest(1, y1 - y0) / 14.0::DOUBLE AS r, y0 <= 20 AND y1 - y0 >= 18 AS heading, pos % 3 = 1 AS wraps, pos % 7 = 0 AS split FROM boxes), n AS (SELECT *, length(regexp_replace(text, '\\s', '', 'g')) AS n, regexp_matches(text, '\\S\\n\\S') AS many FROM t)
  SELECT page, bool_or(NOT split AND NOT many AND n > 10 AND CASE WHEN heading THEN n >= 12 AND w >= 120 ELSE NOT (NOT wraps AND n <= 28 AND r <= 1.14::DOUBLE) AND NOT (wraps AND (r >= 1.55::DOUBLE OR (n >= 48 AND r >= 1.35::DOUBLE))) END) AS probed FROM n GROUP BY page""")
def _probed(s, d):
    b = boxes(s, d).withColumn("text", F.expr(_TEXT))
    height = F.col("y1") - F.col("y0")
    worth = wrapping.probe_worth(F.col("text"), F.col("x1") - F.col("x0"), height, F.lit(14.0), (F.col("y0") <= 20) & (height >= 18), F.col("pos") % 3 == 1, F.col("pos") % 7 == 0)
    return b.groupBy("page").agg(F.bool_or(worth).alias("probed"))


_CARD_TEXT = "CASE provider WHEN 'A' THEN 'a line of words' WHEN 'N' THEN '数据说明文字' ELSE 'ab' END"


@query("q_card_regions", f"""WITH {BOXES}, {REGIONS}, t AS (SELECT *, {_CARD_TEXT} AS text FROM boxes WHERE provider <> 'R' AND y1 - y0 >= 0.6::DOUBLE * 20),
  g AS (SELECT a.page, a.region, (a.x1 - a.x0) * (a.y1 - a.y0) AS whole, count(*) AS n, count(*) FILTER (b.provider = 'N') AS cjk, sum(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS inter FROM regions a JOIN t b ON a.page = b.page AND b.x0 + b.x1 BETWEEN 2 * a.x0 AND 2 * a.x1 AND b.y0 + b.y1 BETWEEN 2 * a.y0 AND 2 * a.y1 GROUP BY ALL)
  SELECT page, region, n, cjk FROM g WHERE whole / 120000.0::DOUBLE >= 0.1::DOUBLE AND (n >= 4 OR (cjk >= 2 AND n >= 3) OR (n >= 2 AND least(1, inter / whole::DOUBLE) >= 0.05::DOUBLE AND whole / 120000.0::DOUBLE >= 0.14::DOUBLE))""")
def _cards(s, d):
    return recognised.card_regions(regions(s, d), boxes(s, d).withColumn("text", F.expr(_CARD_TEXT)), 400.0, 300.0, 20.0)


#: Rows given here: region forms in JSON, their points as text and their kinds.
FORMS = [
    ('{"left": 1, "top": null, "width": "4", "height": ""}', "1,0;5,0;5,0;1,0", "bbox"),
    ('{"x0": 1, "y0": 2, "x1": 3, "y1": 4}', "1,2;3,2;3,4;1,4", "bbox"),
    ('{"xmin": 1, "ymin": "2", "xmax": 3, "ymax": 4.5}', "1,2;3,2;3,4.5;1,4.5", "bbox"),
    ('{"xmin": 1, "ymin": "no", "xmax": 3, "ymax": 4}', None, "bbox"),
    ('{"x0": 1}', None, "bbox"),
    ('[{"x": 1, "y": 2}, {"left": 3, "top": 4}, {"x": null, "left": 5, "y": 6}]', "1,2;3,4;5,6", "polygon"),
    ('[{"x": 1}]', None, "polygon"),
    ("[[1, 2], [3, 4, 9]]", "1,2;3,4", "polygon"),
    ("[[1, 2], [3]]", None, "bbox"),
    ("[1, 2, 3, 4, 5, 6, 7, 8]", "1,2;3,4;5,6;7,8", "polygon"),
    ('[1, 2, 3, 4, 5, 6, 7, "8"]', None, "polygon"),
    ("[4, 3, 2, 1]", "4,3;2,3;2,1;4,1", "bbox"),
    ("[1, 2, 3]", None, "bbox"),
    ("[]", None, "bbox"),
    ("7", None, "bbox"),
    ("no", None, "bbox"),
    (None, None, "bbox"),
]


def _literal(value: object) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value).lower()


def _values(rows: list[tuple], names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(map(_literal, r[1:]))})" for i, r in enumerate(rows)) + f") v(row, {names})"


def _plain(points):
    """Points as text, whole numbers without a fraction."""
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", *(F.regexp_replace(p[n].cast("string"), r"\.0$", "") for n in ("x", "y")))), ";")


@query("q_outlines", _values(FORMS, "points, kind"))
def _outlines(s, d):
    rows = s.createDataFrame([(i, r[0]) for i, r in enumerate(FORMS)], "row int, t string")
    return rows.select("row", _plain(outlines.layout_points(F.col("t"))).alias("points"), outlines.layout_kind(F.col("t"), F.lit("detector")).alias("kind"))


#: Region entries in JSON: sides, label, kind and points.
ENTRIES = [
    ("[3, 4, 1, 2]", "1.0 2.0 3.0 4.0", None, None, None),
    ('{"bbox_pt": [1, 2, "3", 4], "label": "a", "geometry_kind": " BBox ", "geometry_points": [[1, 2], [3, 4]]}', "1.0 2.0 3.0 4.0", "a", "bbox", None),
    ('{"bbox": [1, 2, 3, 4], "bbox_pt": null, "geometry_points_pt": [[1, 2], [3, 4], [5, 6]]}', "1.0 2.0 3.0 4.0", None, "polygon", "1,2;3,4;5,6"),
    ('{"bbox": [1, 2, 3]}', None, None, None, None),
    ('{"label": "a"}', None, None, None, None),
    ('[1, 2, 3, "x"]', None, None, None, None),
    ("no", None, None, None, None),
    (None, None, None, None, None),
]


@query("q_region_entries", _values(ENTRIES, "sides, label, kind, points"))
def _entries(s, d):
    rows = s.createDataFrame([(i, r[0]) for i, r in enumerate(ENTRIES)], "row int, t string").select("row", outlines.region_entry(F.col("t")).alias("e"))
    sides = F.when(F.col("e").isNotNull(), F.concat_ws(" ", *(F.col(f"e.{n}").cast("string") for n in ("x0", "y0", "x1", "y1"))))
    return rows.select("row", sides.alias("sides"), "e.label", "e.kind", _plain(F.col("e.points")).alias("points"))


#: Provider, model, chain; then the route and its flags.
PLANS = [
    (("baidu", "paddleocr-vl", None), "machine_ocr", False, False, False, False, False, True),
    (("paddle_local", None, None), "machine_ocr", False, True, True, True, False, False),
    (("tesseract", "PaddleOCR-VL", "doc_parser"), "machine_ocr", False, True, True, True, False, False),
    (("paddle", None, None), "remote_doc_parser", True, False, False, True, True, False),
    (("aiocr", "x/PaddleOCR-VL-0.9", None), "remote_prompt_ocr", True, False, False, True, True, False),
    (("aiocr", None, " Doc_Parser"), "remote_doc_parser", False, False, False, True, True, False),
    (("aiocr", "m", "layout_block"), "local_layout_block_ocr", False, False, False, True, True, False),
    (("aiocr", "m", "other"), "remote_prompt_ocr", False, False, False, True, True, False),
    (("auto", "paddleocr-vl", "layout_block"), "hybrid_auto", True, True, True, True, True, False),
    (("auto", None, None), "hybrid_auto", False, True, True, True, False, False),
    (("remote", "paddleocr-vl", None), "unknown", True, True, False, False, False, False),
    ((None, None, None), "unknown", False, True, False, False, False, False),
]


@query("q_route_plans", _values(PLANS, "kind, " + ", ".join(settings.ROUTE_FLAGS)))
def _routes(s, d):
    rows = s.createDataFrame([(i, *r[0]) for i, r in enumerate(PLANS)], "row int, provider string, model string, chain string")
    return rows.select("row", settings.route_plan(F.col("provider"), F.col("model"), F.col("chain")).alias("p")).select("row", "p.*")

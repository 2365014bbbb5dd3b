"""Queries over recognised lines: boxes that take their texts in turn from a literal list."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as txt
from ..operators import recognised
from ..sources.tables import BOXES, boxes
from .catalog import query
from .pages import INTER
from .texts import _LABELS, _OPENINGS

#: Texts of the lines, in Spark and in DuckDB.
TEXTS = (
    "AI", "x", "Q", "ab", "EF", "FRM", "GFE", "api", "Probability", "worst70%", "5%", "......", "-- -", " 能力", "它crt", "・一・・", "中文标题与正文内容", "ordinary words here",
    "region_4", "", None, "A.", "GPU", "T os", "ran", "14%", "(Title)", "two\nlines", "1999", "能力能力能", "long line of forty and more characters, all told",
)
_LIST = ", ".join("NULL" if t is None else "'" + t.replace("\n", "' || chr(10) || '") + "'" for t in TEXTS)
#: Pages of every fifth number have CJK lines for half of their texts.
ITEMS = f"{BOXES}, items AS (SELECT *, CASE WHEN page % 5 = 0 AND pos % 2 = 0 THEN '中文标题与正文内容' ELSE ([{_LIST}])[1 + (pos * 7 + page) % {len(TEXTS)}] END AS text, confidence / 10::DOUBLE AS conf, y1 - y0 AS h, x1 - x0 AS w FROM boxes)"
PACKED = "p AS (SELECT *, regexp_replace(coalesce(text, ''), '\\s', '', 'g') AS p, regexp_replace(coalesce(text, ''), '[^\\p{L}]', '', 'g') AS a, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS q, greatest(w, 1) * greatest(h, 1) / 720000::DOUBLE AS share, h / 720::DOUBLE AS tall FROM items)"
NOISE = f"""(p = '' OR q IN ({_LABELS}) OR regexp_full_match(q, 'region[_\\s-]?[0-9]{{1,4}}') OR {_OPENINGS} OR NOT regexp_matches(p, '[\\p{{L}}\\p{{N}}]')
    OR (regexp_matches(p, '\\p{{L}}') AND NOT regexp_matches(p, '\\p{{Nd}}') AND NOT regexp_matches(p, '{txt.CJK}') AND upper(a) NOT IN {recognised.ACRONYMS}
      AND CASE WHEN length(p) = 1 THEN share < 0.002::DOUBLE OR tall >= 0.08::DOUBLE WHEN length(p) = 2 AND upper(p) = p AND lower(p) <> p THEN share < 0.0007::DOUBLE OR tall >= 0.1::DOUBLE
        WHEN length(p) = 2 THEN share < 0.0012::DOUBLE OR tall >= 0.08::DOUBLE WHEN length(p) <= 4 AND upper(p) = p AND lower(p) <> p THEN share < 0.0009::DOUBLE OR tall >= 0.11::DOUBLE ELSE false END))"""


def _items(s, d):
    """Boxes with a text and a confidence of 0 to 1."""
    given = F.element_at(F.array(*map(F.lit, TEXTS)), (1 + (F.col("pos") * 7 + F.col("page")) % len(TEXTS)).cast("int"))
    text = F.when((F.col("page") % 5 == 0) & (F.col("pos") % 2 == 0), "中文标题与正文内容").otherwise(given)
    return boxes(s, d).withColumns({"text": text, "confidence": F.col("confidence") / 10.0})


@query("q_noise_lines", f"WITH {ITEMS}, {PACKED} SELECT page, pos, {NOISE} AS noise FROM p")
def _noise(s, d):
    return _items(s, d).select("page", "pos", recognised.noise_line(F.col("text"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), 1000, 720).alias("noise"))


@query("q_normal_lines", rf"""WITH {ITEMS}, {PACKED}, k AS (SELECT page, pos, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, least(x0, 599)::DOUBLE AS x0, least(y0, 399)::DOUBLE AS y0, least(x1, 600)::DOUBLE AS x1, least(y1, 400)::DOUBLE AS y1
    FROM (SELECT * REPLACE (w * h / 240000::DOUBLE AS share, h / 400::DOUBLE AS tall) FROM p) WHERE NOT {NOISE})
  SELECT page, pos, text, x0, y0, x1, y1, row_number() OVER (PARTITION BY page ORDER BY y0 + y1, x0, pos) AS rank FROM k WHERE x1 > x0 AND y1 > y0""")
def _normal(s, d):
    return recognised.normalised(_items(s, d), 600, 400).select("page", "pos", "text", "x0", "y0", "x1", "y1", "rank")


@query("q_context_lines", f"""WITH {ITEMS}, {PACKED}, c AS (SELECT *, length(p) AS n, length(a) AS la, regexp_matches(p, '\\p{{Nd}}') AS digit, len(regexp_extract_all(p, '{txt.CJK}')) AS cjk FROM p WHERE p <> ''),
  g AS (SELECT *, sum(cjk) OVER (PARTITION BY page) >= 0.32::DOUBLE * sum(n) OVER (PARTITION BY page) AS on_cjk FROM c)
  SELECT page, pos FROM g WHERE NOT (on_cjk AND ((la > 0 AND NOT digit AND ((la <= 4 AND upper(a) NOT IN {recognised.ACRONYMS} AND share < 0.012::DOUBLE) OR (la <= 6 AND lower(a) = a AND upper(a) <> a AND share < 0.015::DOUBLE) OR (cjk = 0 AND la >= 7 AND share < 0.0035::DOUBLE) OR (cjk > 0 AND n <= 7 AND la <= 4)))
    OR (la = 0 AND cjk > 0 AND n <= 4 AND list_max([n - length(replace(p, x, '')) FOR x IN string_split(p, '')]) >= 3) OR (la > 0 AND digit AND cjk = 0 AND n <= 14 AND share < 0.004::DOUBLE) OR (la = 0 AND digit AND cjk = 0 AND n <= 5 AND share < 0.0015::DOUBLE)))
    AND NOT (cjk = 0 AND n <= 8 AND conf > 0 AND conf < 0.45::DOUBLE AND share < 0.02::DOUBLE)""")
def _context(s, d):
    return recognised.in_context(_items(s, d), 1000, 720).select("page", "pos")


@query("q_multi_lines", f"""WITH {ITEMS}, n AS (SELECT *, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) AS n, CASE WHEN pos % 4 = 0 THEN 0 ELSE 6 + pos % 8 END AS m FROM items), l AS (SELECT *, CASE WHEN m > 0 THEN m::DOUBLE ELSE 10.0::DOUBLE END AS line FROM n)
  SELECT page, pos, coalesce((contains(text, chr(10)) AND n >= 3) OR (n >= 8 AND NOT (w >= 0.28::DOUBLE * 400 AND h / w::DOUBLE <= 0.11::DOUBLE AND n <= 42 AND h <= greatest(line * 3.6::DOUBLE, 0.16::DOUBLE * 200))
    AND (h >= greatest(line * 1.8::DOUBLE, 0.055::DOUBLE * 200) OR (h >= greatest(line * 1.45::DOUBLE, 0.045::DOUBLE * 200) AND (n >= 16 OR w >= 0.3::DOUBLE * 400)))), false) AS several FROM l""")
def _several(s, d):
    median = F.when(F.col("pos") % 4 == 0, 0).otherwise(6 + F.col("pos") % 8)
    return _items(s, d).select("page", "pos", recognised.spans_lines(F.col("text"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), 400, 200, median).alias("several"))


@query("q_wide_flat_pages", f"""WITH {BOXES}, b AS (SELECT page * 20 + pos % 20 AS page, provider, 350 + 4 * (x1 - x0) AS w, y1 - y0 AS h, y0 % 150 AS y0, y0 % 150 + y1 - y0 AS y1 FROM boxes)
  SELECT page FROM b WHERE provider = 'R' GROUP BY page HAVING count(*) <= 3 AND bool_and(w >= 7 * h) AND max(y1) - min(y0) <= 0.28 * 720 AND max(w) >= 650""")
def _flat(s, d):
    label = F.expr("case provider when 'R' then 'paragraph title' when 'A' then 'Page-Footer' else 'screen shot figure' end")
    blocks = boxes(s, d).selectExpr("page * 20 + pos % 20 as page", "provider", "0 as x0", "350 + 4 * (x1 - x0) as x1", "y0 % 150 as y0", "y0 % 150 + y1 - y0 as y1")
    return recognised.wide_flat_pages(blocks.withColumn("label", label), 1000, 720)


@query("q_fragments", f"""WITH {ITEMS}, t AS (SELECT * FROM items WHERE provider <> 'A' AND length(regexp_replace(text, '\\s', '', 'g')) >= 4 AND h >= 0.55::DOUBLE * 20)
  SELECT b.page, b.pos FROM items b WHERE b.provider = 'A' AND b.w * b.h <= 0.015::DOUBLE * 720000 AND EXISTS (SELECT 1 FROM t a WHERE a.page = b.page AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND ({INTER} / (b.w * b.h)::DOUBLE >= 0.72::DOUBLE
    OR ((least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.h, b.h)::DOUBLE >= 0.68::DOUBLE AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.w, b.w)::DOUBLE >= 0.1::DOUBLE AND (a.w >= 1.1::DOUBLE * b.w OR {INTER} / (b.w * b.h)::DOUBLE >= 0.55::DOUBLE))))""")
def _fragments(s, d):
    items = _items(s, d)
    return recognised.fragments(items.where("provider = 'A'"), items.where("provider <> 'A'"), 1000, 720, 20.0).select("page", "pos")


@query("q_distinct_boxes", None)
def _distinct(s, d):
    return recognised.distinct_boxes(boxes(s, d), 40.0)

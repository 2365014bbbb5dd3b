"""Queries over payload items: their kinds, boxes, confidences, messages and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kinds, shapes
from ..functions import text as txt
from ..sources.tables import BOXES, EVENTS, boxes, job_events, table
from .catalog import query
from .texts import LINES, SQUEEZE, _lines

#: Literal kinds, labels and errors that no table holds, in Spark and in DuckDB.
KINDS = (
    "Image", "inline_equation", "img", "Seal", "figure-caption", "page footer", "Page-Number/3", "Footer", "footers", "icon", "doc title image", " PHOTO ", "picture",
    "screen shot", "screenshot", "503 Service Unavailable", "HTTP 404", "model X does not support y", "Read timed out", "latex", "", None, "text", "chart/bar", "page number",
)
_ROWS = ", ".join(f"({i}, {'NULL' if k is None else chr(39) + k + chr(39)})" for i, k in enumerate(KINDS))


def _any(value: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches(lower(coalesce({value}, '')), '{'|'.join(words)}')"


@query("q_kinds", rf"""WITH k AS (SELECT id::BIGINT AS id, t FROM (VALUES {_ROWS}) v(id, t) UNION ALL SELECT 1000 + doc_id, source FROM documents),
  l AS (SELECT id, t, lower(regexp_replace(coalesce(t, ''), '^\s+|\s+$', '', 'g')) AS q, translate(lower(regexp_replace(coalesce(t, ''), '^\s+|\s+$', '', 'g')), '- /', '___') AS label FROM k)
  SELECT id, {_any('t', kinds.CONTENT_IMAGES)} AS content_image, {_any('t', kinds.PARSER_IMAGES)} AS parser_image, NOT {_any('label', kinds.LABEL_OTHERS)} AND {_any('label', kinds.LABEL_IMAGES)} AS label_image, {_any('t', kinds.FORMULA_SPANS)} AS formula,
    q IN {kinds.IMAGE_SPANS} AS image_span, label IN ('footer', 'page_number') OR suffix(label, '_footer') OR starts_with(label, 'page_number') AS skipped,
    (id % 600 IN {kinds.RETRY_STATUS}) OR {_any('t', kinds.RETRY_WORDS)} AS retry, {_any('t', kinds.UNSUPPORTED_WORDS)} AS unsupported FROM l""")
def _kinds(s, d):
    rows = s.createDataFrame(list(enumerate(KINDS)), "id long, t string")
    rows = rows.unionByName(table(s, d, "documents").select((F.col("doc_id") + 1000).alias("id"), F.col("source").alias("t")))
    t = F.col("t")
    return rows.select(
        "id",
        kinds.holds(t, kinds.CONTENT_IMAGES).alias("content_image"),
        kinds.holds(t, kinds.PARSER_IMAGES).alias("parser_image"),
        kinds.image_label(t).alias("label_image"),
        kinds.holds(t, kinds.FORMULA_SPANS).alias("formula"),
        kinds.image_span(t).alias("image_span"),
        kinds.skipped_block(t).alias("skipped"),
        kinds.retryable(F.col("id") % 600, t).alias("retry"),
        kinds.holds(t, kinds.UNSUPPORTED_WORDS).alias("unsupported"),
    )


@query("q_export_gate", "SELECT o_orderkey AS id, coalesce(CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END, false) AND (coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 5 END, 0) = 0 OR o_orderkey % 7 <= o_custkey % 5) AS kept FROM orders")
def _export(s, d):
    enabled = F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False)
    most = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 5)
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), kinds.exports_pages(enabled, F.col("o_orderkey") % 7, most).alias("kept"))


def _formed(forms: tuple[str, ...]):
    return F.expr(f"case pos % {len(forms)} " + " ".join(f"when {i} then format_string({f})" for i, f in enumerate(forms)) + " end")


def _shown(df):
    return df.select("page", "pos", "b.x0", "b.y0", "b.x1", "b.y1")


@query("q_vendor_box", f"""WITH {BOXES}, f AS (SELECT *, pos % 8 AS f, x1 - x0 AS w, y1 - y0 AS h FROM boxes), g AS (SELECT *, f = 1 AND w > x0 AND h > y0 AS bare, f = 7 OR (f = 4 AND (x0 = 0 OR y0 = 0)) AS none FROM f)
  SELECT page, pos, CASE WHEN NOT none THEN x0::DOUBLE END AS x0, CASE WHEN NOT none THEN y0::DOUBLE END AS y0, CASE WHEN bare THEN w::DOUBLE WHEN NOT none THEN x1::DOUBLE END AS x1, CASE WHEN bare THEN h::DOUBLE WHEN NOT none THEN y1::DOUBLE END AS y1 FROM g""")
def _vendor(s, d):
    """Boxes written as vendors' items in every form and one that is none, then read back."""
    forms = (
        "'{\"position\": [%d, %d, %d, %d], \"bbox\": [1, 2, 3, 4]}', x0, y0, x1 - x0, y1 - y0",
        "'[%d, %d, %d, %d]', x0, y0, x1 - x0, y1 - y0",
        "'{\"bbox\": [\"%dpt\", \" %d PT \", \"%d\", %d]}', x0, y0, x1, y1",
        "'{\"box\": [1], \"poly\": [%1$d, %2$d, %3$d, %2$d, %3$d, %4$d, %1$d, %4$d]}', x0, y0, x1, y1",
        "'{\"left\": %d, \"top\": %d, \"right\": %d, \"bottom\": %d}', x0, y0, x1, y1",
        "'{\"location\": [[%d, %d], [%d, \"%d\"]]}', x1, y0, x0, y1",
        "'{\"x\": %d, \"y\": %d, \"w\": %d, \"h\": %d}', x0, y0, x1 - x0, y1 - y0",
        "'{\"bbox\": [%d, %d], \"left\": 3}', x0, y0",
    )
    return _shown(boxes(s, d).select("page", "pos", shapes.vendor_box(_formed(forms)).alias("b")))


@query("q_content_box", f"""WITH {BOXES} SELECT page, pos, CASE pos % 4 WHEN 0 THEN x1 WHEN 3 THEN NULL ELSE x0 END::DOUBLE AS x0, CASE WHEN pos % 4 < 3 THEN y0 END::DOUBLE AS y0, CASE pos % 4 WHEN 0 THEN x0 WHEN 3 THEN NULL ELSE x1 END::DOUBLE AS x1, CASE WHEN pos % 4 < 3 THEN y1 END::DOUBLE AS y1 FROM boxes""")
def _content(s, d):
    forms = (
        "'{\"bbox\": [%d, %d, \"%d\", %d]}', x1, y0, x0, y1",
        "'{\"poly\": [%1$d, %2$d, %3$d, %2$d, %3$d, %4$d, %1$d, %4$d]}', x0, y0, x1, y1",
        "'{\"bbox\": [1, 2], \"poly\": [%1$d, %2$d, %3$d, %2$d, %3$d, %4$d, %1$d, %4$d, %1$d]}', x0, y0, x1, y1",
        "'{\"bbox\": [%1$d, \"a\", 1, 2], \"poly\": [%1$d, %1$d, %1$d, %1$d, %1$d, %1$d, %1$d, %1$d]}', x0",
    )
    return _shown(boxes(s, d).select("page", "pos", shapes.content_box(_formed(forms)).alias("b")))


@query("q_page_entry", f"WITH {BOXES}, v AS (SELECT page, pos, CASE WHEN pos % 5 = 4 OR (pos % 5 > 0 AND x0 = 0) THEN NULL ELSE x1 END AS w, y1 AS h FROM boxes) SELECT page, pos, w::DOUBLE AS width, CASE WHEN w IS NOT NULL THEN h END::DOUBLE AS height FROM v")
def _page_entry(s, d):
    forms = (
        "'{\"page_size\": [\"%dpt\", %d], \"page_w\": 1, \"page_h\": 2}', x1, y1",
        "'{\"page_size\": [%4$d], \"page_width\": %1$d, \"page_height\": %2$d}', if(x0 = 0, 0, x1), y1, x0, y0",
        "'{\"page_w\": %d, \"page_h\": %d}', if(x0 = 0, -1, x1), y1",
        "'{\"page_width\": 0, \"meta\": {\"width\": %d, \"page_h\": %d}}', if(x0 = 0, 0, x1), y1",
        "'[%d, %d]', x1, y1",
    )
    out = boxes(s, d).select("page", "pos", shapes.page_size(_formed(forms)).alias("b"))
    return out.select("page", "pos", "b.width", "b.height")


@query("q_crop_rect", f"""WITH {BOXES}, c AS (SELECT page, pos, least(greatest(CAST(round_even((x0 - 1.75::DOUBLE) * 150.0::DOUBLE / 72.0::DOUBLE, 0) AS BIGINT) - 300, 0), 799) AS x0, least(greatest(CAST(round_even((y0 - 0.5::DOUBLE) * 150.0::DOUBLE / 72.0::DOUBLE, 0) AS BIGINT) - 200, 0), 499) AS y0,
    least(greatest(CAST(round_even((x1 + 1.75::DOUBLE) * 150.0::DOUBLE / 72.0::DOUBLE, 0) AS BIGINT) - 300, 0), 800) AS x1, least(greatest(CAST(round_even((y1 + 0.5::DOUBLE) * 150.0::DOUBLE / 72.0::DOUBLE, 0) AS BIGINT) - 200, 0), 500) AS y1 FROM boxes)
  SELECT page, pos, CASE WHEN x1 > x0 AND y1 > y0 THEN x0 END AS x0, CASE WHEN x1 > x0 AND y1 > y0 THEN y0 END AS y0, CASE WHEN x1 > x0 AND y1 > y0 THEN x1 END AS x1, CASE WHEN x1 > x0 AND y1 > y0 THEN y1 END AS y1 FROM c""")
def _crop(s, d):
    crop = F.struct(*(F.lit(v).alias(n) for n, v in (("x0", 300), ("y0", 200), ("width", 800), ("height", 500))))
    return _shown(boxes(s, d).select("page", "pos", shapes.crop_rect(F.struct("x0", "y0", "x1", "y1"), crop, 150, 1.75, 0.5).alias("b")))


@query("q_filled", r"SELECT conv_id, turn, regexp_replace('You are ' || role || ': ' || coalesce(text, '') || ' {{ other }} {{role', '^\s+|\s+$', '', 'g') AS prompt FROM conversations")
def _filled(s, d):
    prompt = txt.filled(F.lit("  You are {{role}}: {{ text }} {{ other }} {{role "), {"role": F.col("role"), "text": F.col("text")})
    return table(s, d, "conversations").select("conv_id", "turn", prompt.alias("prompt"))


@query("q_without_tags", r"SELECT conv_id, turn, trim(regexp_replace('a & ' || replace(replace(replace(coalesce(text, ''), '<', '('), '>', ')'), '&', '+') || ' <x>', '\s+', ' ', 'g')) AS plain FROM conversations")
def _without_tags(s, d):
    safe = F.translate(F.coalesce("text", F.lit("")), "<>&", "()+")
    raw = F.concat(F.lit("&lt;|ref|&gt; a &amp;amp; <|/ref|>"), safe, F.lit(" &amp;lt;|det|&amp;gt;&lt;x>"))
    return table(s, d, "conversations").select("conv_id", "turn", txt.without_tags(raw).alias("plain"))


@query("q_item_confidence", f"""WITH {EVENTS}, v AS (SELECT event_id, CASE WHEN event_id % 5 < 3 THEN (progress * 7 - 30)::DOUBLE ELSE 0.7::DOUBLE END AS v FROM ev)
  SELECT event_id, greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN v > 1 AND v <= 100 THEN v / 100 ELSE v END)) AS confidence FROM v""")
def _confidence(s, d):
    item = """case event_id % 5 when 0 then format_string('{"confidence": %d, "c": 1}', v) when 1 then format_string('{"confidence": null, "c": "%d"}', v)
      when 2 then format_string('{"prob": %d}', v) when 3 then '{}' else '{"score": "bad"}' end"""
    items = job_events(s, d).selectExpr("event_id", "cast(progress * 7 - 30 as bigint) as v").select("event_id", F.expr(item).alias("item"))
    return items.select("event_id", shapes.item_confidence(F.col("item")).alias("confidence"))


@query("q_message_text", r"""WITH c AS (SELECT conv_id, turn, nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') AS t, role FROM conversations)
  SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat_ws(chr(10), t, role) WHEN 1 THEN concat_ws(chr(10), role, t) WHEN 2 THEN 'z' ELSE ' ' || role END AS message FROM c""")
def _message(s, d):
    content = (
        F.when(F.col("turn") % 4 == 0, F.to_json(F.array("text", "role")))
        .when(F.col("turn") % 4 == 1, F.to_json(F.array(F.struct(F.col("role").alias("text"), F.lit(None).cast("string").alias("content")), F.struct(F.lit(None).cast("string").alias("text"), F.col("text").alias("content")))))
        .when(F.col("turn") % 4 == 2, F.lit('[{"text": 5, "content": " z "}, 7, null, "  "]'))
        .otherwise(F.concat(F.lit('" '), "role", F.lit('"')))
    )
    return table(s, d, "conversations").select("conv_id", "turn", txt.message_text(content).alias("message"))


@query("q_short_text", f"WITH {LINES}, q AS (SELECT doc, line_no, {SQUEEZE} AS q FROM lines) SELECT doc, line_no, CASE WHEN length(q) <= 40 THEN q ELSE left(q, 37) || '...' END AS shown FROM q")
def _short_text(s, d):
    return _lines(s, d).select("doc", "line_no", txt.short_text(F.col("t"), 40).alias("shown"))


@query("q_wrap_tokens", rf"""WITH {LINES} SELECT doc, line_no, CASE WHEN NOT regexp_matches(t, '{txt.CJK}') AND contains(t, ' ') THEN array_to_string([w FOR w IN string_split(t, ' ') IF w <> ''], '| |')
  ELSE array_to_string([CASE WHEN regexp_matches(r, '^\s') THEN ' ' ELSE r END FOR r IN regexp_extract_all(t, '\s+|[A-Za-z0-9_\-./:+#%&@]+|\S')], '|') END AS tokens FROM lines""")
def _tokens(s, d):
    return _lines(s, d).select("doc", "line_no", F.array_join(txt.wrap_tokens(F.col("t")), "|").alias("tokens"))

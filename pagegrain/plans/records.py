"""Queries of nested page records, of states of jobs and of results of several providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout, records
from ..sources.tables import BOXES, EVENTS, REGIONS, boxes, job_events, regions, table
from .catalog import query

SPANS = f"""{BOXES}, s AS (SELECT page, pos // 6 AS block, pos // 2 AS line, pos, CASE WHEN pos % 5 = 0 THEN '  ' WHEN pos % 7 = 0 THEN NULL ELSE ' w' || pos || ' ' END AS text, y1 - y0 AS size, provider AS font, x0 * 1000 AS color, confidence * 3 AS flags FROM boxes)"""


@query("q_text_lines", f"""WITH {SPANS}, g AS (SELECT page, CASE WHEN line % 3 = 0 THEN -1 ELSE line END::DOUBLE AS x0, string_agg(coalesce(text, ''), '' ORDER BY pos) AS text, arg_max((size, font, color, flags), (length(trim(coalesce(text, ''))), -pos)) AS style FROM s WHERE block % 4 <> 3 GROUP BY page, block, line)
  SELECT page, x0, text, style[1]::DOUBLE AS size, style[2] AS font, '#' || lpad(lower(to_hex(style[3] & 16777215)), 6, '0') AS colour, style[4] & 16 <> 0 AS bold, style[4] & 2 <> 0 AS italic FROM g WHERE trim(text) <> ''""")
def _text_lines(s, d):
    pos = F.col("pos")
    text = F.when(pos % 5 == 0, "  ").when(pos % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit(" w"), pos.cast("string"), F.lit(" ")))
    span = F.struct(text.alias("text"), (F.col("y1") - F.col("y0")).cast("double").alias("size"), F.col("provider").alias("font"), (F.col("x0") * 1000).alias("color"), (F.col("confidence") * 3).alias("flags"))
    rows = boxes(s, d).select("page", F.expr("pos div 6").alias("block"), F.expr("pos div 2").alias("line"), "pos", span.alias("span"))
    lines = rows.groupBy("page", "block", "line").agg(F.sort_array(F.collect_list(F.struct("pos", "span"))).alias("p"))
    box = F.array(F.col("line").cast("double"), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    # a third of the lines have no box of their own and take their block's
    own = F.struct(F.when(F.col("line") % 3 != 0, box).alias("bbox"), F.col("p.span").alias("spans"))
    blocks = lines.groupBy("page", "block").agg(F.sort_array(F.collect_list(F.struct("line", own.alias("l")))).alias("x"))
    made = blocks.select("page", "block", F.struct(F.when(F.col("block") % 4 == 3, 1).otherwise(0).alias("type"), F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"), F.col("x.l").alias("lines")).alias("b"))
    pages = made.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("block", "b"))).alias("p")).select("page", F.col("p.b").alias("blocks"))
    return records.text_lines(pages).select("page", F.element_at("bbox", 1).alias("x0"), "text", "size", "font", "colour", "bold", "italic")


@query("q_table_cells", """WITH t AS (SELECT o_orderkey AS "table", o_custkey % 4 AS rows, o_orderkey % 3 + 1 AS cols FROM orders), c AS (SELECT "table", rows, cols, unnest(range(rows * cols)) AS i FROM t WHERE rows > 0)
  SELECT "table", i // cols AS r, i % cols AS c, CASE WHEN i // cols < rows - 1 AND i % cols < 2 THEN (i // cols) || ':' || (i % cols) ELSE '' END AS text, CASE WHEN i < 4 THEN i::DOUBLE ELSE 0 END AS x0 FROM c""")
def _cells(s, d):
    rows, cols = F.col("o_custkey") % 4, F.col("o_orderkey") % 3 + 1
    texts = F.transform(F.slice(F.array(*[F.lit(i) for i in range(4)]), F.lit(1), F.greatest(F.lit(0), rows - 1).cast("int")), lambda r: F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), cols.cast("int")), lambda c: F.concat(r.cast("string"), F.lit(":"), c.cast("string"))))
    four = F.array(*[F.array(*[F.lit(float(i))] * 4) for i in range(4)])
    tables = table(s, d, "orders").select(F.col("o_orderkey").alias("table"), rows.alias("rows"), cols.alias("cols"), texts.alias("texts"), four.alias("boxes"))
    return records.table_cells(tables).select("table", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "text", F.element_at("bbox", 1).alias("x0"))


@query("q_job_states", f"""WITH {EVENTS}, u AS (SELECT job, ts, event_id, CASE WHEN event_id % 4 <> 0 THEN status END AS status, CASE WHEN event_id % 3 <> 0 THEN progress * 2 - 20 END AS progress FROM ev),
  e AS (SELECT *, first_value(CASE WHEN status IN ('purchase', 'error') THEN status END IGNORE NULLS) OVER (PARTITION BY job ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM u), a AS (SELECT *, ended IS NULL OR coalesce(status = ended, false) AS applied FROM e)
  SELECT job, event_id, applied, last_value(CASE WHEN applied THEN status END IGNORE NULLS) OVER w AS status, last_value(CASE WHEN applied THEN progress END IGNORE NULLS) OVER w AS progress, max(CASE WHEN applied THEN least(greatest(progress, 0), 99) END) OVER w AS reported FROM a WINDOW w AS (PARTITION BY job ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _states(s, d):
    n = F.col("event_id")
    updates = job_events(s, d).withColumns({"status": F.when(n % 4 != 0, F.col("status")), "progress": F.when(n % 3 != 0, F.col("progress") * 2 - 20)})
    return records.job_states(updates, ("purchase", "error"))


@query("q_ttl_reads", f"""WITH {EVENTS}, v AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN progress END AS value FROM ev), l AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS wrote, last_value(value IGNORE NULLS) OVER w AS held FROM v WINDOW w AS (PARTITION BY job ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT job, event_id, CASE WHEN epoch_us(wrote) + 432000000000 > epoch_us(ts) THEN held END AS found FROM l WHERE value IS NULL""")
def _ttl(s, d):
    return records.ttl_reads(job_events(s, d).withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("progress"))), 432_000)


@query("q_fallback", f"""WITH {BOXES}, r AS (SELECT page * 10 + pos % 10 AS page, provider, count(*) FILTER (confidence >= 6) AS found FROM boxes GROUP BY ALL), k AS (SELECT *, CASE provider WHEN 'N' THEN 1 WHEN 'A' THEN 2 WHEN 'R' THEN 3 END AS rank FROM r)
  SELECT page, arg_min(provider, rank) FILTER (found > 0) AS provider, arg_min(found, rank) FILTER (found > 0) AS found FROM k GROUP BY page""")
def _fallback(s, d):
    results = boxes(s, d).groupBy((F.col("page") * 10 + F.col("pos") % 10).alias("page"), "provider").agg(F.count_if(F.col("confidence") >= 6).alias("found"))
    return records.first_available(results, ("N", "A", "R"))


@query("q_merged_segments", f"""WITH {BOXES}, w AS (SELECT *, y0 // 40 AS "row", CASE WHEN pos % 7 = 0 THEN '中' WHEN pos % 5 = 0 THEN 'end.' ELSE 'w' || pos END AS text FROM boxes), f AS (SELECT *, CASE WHEN x0 - lag(x1) OVER o > 30 THEN 1 ELSE 0 END AS fresh FROM w WINDOW o AS (PARTITION BY page, "row" ORDER BY x0, pos)),
  g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY page, "row" ORDER BY x0, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM f), b AS (SELECT *, lag(text) OVER (PARTITION BY page, "row", segment ORDER BY x0, pos) AS before FROM g),
  p AS (SELECT *, CASE WHEN before IS NOT NULL AND before <> '中' AND text <> '中' AND before <> 'end.' THEN ' ' ELSE '' END || text AS piece FROM b)
  SELECT page, "row", segment, string_agg(piece, '' ORDER BY x0, pos) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(avg(confidence), 6) AS confidence FROM p GROUP BY page, "row", segment""")
def _merged(s, d):
    pos = F.col("pos")
    text = F.when(pos % 7 == 0, "中").when(pos % 5 == 0, "end.").otherwise(F.concat(F.lit("w"), pos.cast("string")))
    words = layout.x_segments(boxes(s, d).withColumns({"row": F.expr("y0 div 40"), "text": text}), 30)
    return records.merged_segments(words, "page", "row", "segment").withColumn("confidence", F.round("confidence", 6))


@query("q_block_progress", f"""WITH {EVENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY job, status NOT IN ('purchase', 'error') ORDER BY event_id) AS k FROM ev)
  SELECT job, count(*) AS total, count(*) FILTER (status = 'purchase') AS success, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status NOT IN ('purchase', 'error')) AS pending, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (status NOT IN ('purchase', 'error') AND k <= 3), '') AS unfinished FROM k GROUP BY job""")
def _progress(s, d):
    out = records.block_progress(job_events(s, d).withColumn("id", F.col("event_id")), "job", "purchase", "error", 3)
    return out.withColumn("unfinished", F.array_join(F.col("unfinished").cast("array<string>"), ","))


@query("q_runtime_summary", f"""WITH {BOXES}, e AS (SELECT page, ' ' || provider AS provider, CASE pos % 6 WHEN 0 THEN 'timeout ' WHEN 1 THEN ' ' WHEN 2 THEN 'empty' END AS reason, confidence AS elements, pos % 11 = 0 AS failed FROM boxes),
  p AS (SELECT page, string_agg(v || '=' || n, ',' ORDER BY v) AS providers, count(*) AS kinds FROM (SELECT page, trim(provider) AS v, count(*) AS n FROM e GROUP BY ALL) GROUP BY page), r AS (SELECT page, string_agg(v || '=' || n, ',' ORDER BY v) AS reasons FROM (SELECT page, trim(reason) AS v, count(*) AS n FROM e WHERE trim(reason) <> '' GROUP BY ALL) GROUP BY page),
  c AS (SELECT page, count(*) FILTER (elements > 0) AS with_elements, count(*) FILTER (failed) AS with_errors, count(*) FILTER (trim(reason) <> '') AS fallbacks FROM e GROUP BY page)
  SELECT c.page, with_elements, with_errors, fallbacks, kinds AS distinct_providers, providers, coalesce(reasons, '') AS reasons FROM c JOIN p ON c.page = p.page LEFT JOIN r ON c.page = r.page""")
def _summary(s, d):
    pos = F.col("pos")
    reason = F.when(pos % 6 == 0, "timeout ").when(pos % 6 == 1, " ").when(pos % 6 == 2, "empty")
    entries = boxes(s, d).select("page", F.concat(F.lit(" "), "provider").alias("provider"), reason.alias("reason"), F.col("confidence").alias("elements"), (pos % 11 == 0).alias("failed"))
    out = records.runtime_summary(entries, "page")
    for name in ("providers", "reasons"):
        out = out.withColumn(name, F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))
    return out


@query("q_filled_pages", f"""WITH {BOXES}, {REGIONS}, i AS (SELECT page // 20 AS doc, page % 20 - 1 AS page FROM boxes), z AS (SELECT page // 20 AS doc, page % 20 AS page, max(x1) AS width, max(y1) AS height FROM regions GROUP BY ALL), w AS (SELECT doc, unnest(range(1, 23))::BIGINT AS page FROM (SELECT DISTINCT page // 20 AS doc FROM boxes)),
  c AS (SELECT doc, page, count(*) AS n FROM i WHERE page >= 0 GROUP BY ALL) SELECT w.doc, w.page, coalesce(n, 0) AS n, coalesce(width, 960)::DOUBLE AS width, coalesce(height, 540)::DOUBLE AS height FROM w LEFT JOIN c ON w.doc = c.doc AND w.page = c.page LEFT JOIN z ON w.doc = z.doc AND w.page = z.page""")
def _filled(s, d):
    doc, page = F.expr("page div 20").alias("doc"), (F.col("page") % 20).alias("page")
    sizes = regions(s, d).groupBy(doc, page).agg(F.max("x1").alias("width"), F.max("y1").alias("height"))
    return records.filled_pages(boxes(s, d).select(doc, page), sizes, -1, 1, 22, 960.0, 540.0)


@query("q_split_lines", f"""WITH {BOXES}, b AS (SELECT *, 't' || pos AS text, CASE WHEN pos % 3 = 0 THEN ['a' || pos, 'b', 'c'] WHEN pos % 3 = 1 THEN ['only'] END AS lines FROM boxes), l AS (SELECT *, CASE WHEN len(lines) > 1 THEN lines ELSE [text] END AS l FROM b), u AS (SELECT *, len(l) AS n, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS line FROM l)
  SELECT page, pos, line, t AS text, y0 + (y1 - y0) * line / n AS top, y0 + (y1 - y0) * (line + 1) / n AS bottom FROM u""")
def _split(s, d):
    pos = F.col("pos")
    lines = F.when(pos % 3 == 0, F.array(F.concat(F.lit("a"), pos.cast("string")), F.lit("b"), F.lit("c"))).when(pos % 3 == 1, F.array(F.lit("only")))
    rows = boxes(s, d).withColumn("text", F.concat(F.lit("t"), pos.cast("string")))
    return records.split_lines(rows, boxes(s, d).select("page", "pos", lines.alias("lines")).where("lines is not null"))


@query("q_top_left", f"WITH {BOXES} SELECT page, pos, row_number() OVER (PARTITION BY page ORDER BY y0, x0, pos) AS rank FROM boxes WHERE provider = 'R'")
def _top_left(s, d):
    return layout.top_left(layout.of_kind(boxes(s, d), "provider", "R")).select("page", "pos", "rank")

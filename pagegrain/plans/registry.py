"""Registered queries over the driver tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import scalars
from ..functions import text as txt
from ..operators import events as ev
from ..operators import layout
from ..operators import listing as listing_ops
from ..sources.tables import BOXES, EVENTS, REGIONS, boxes, job_events, regions, table
from . import catalog, grouping, listing, measures, pages, payloads, quality, recognised, records, settings, shaping, texts  # noqa: F401  (all but catalog register their queries)
from .catalog import query

FLAGSHIP = "q_merge_primary"

#: SQL of two boxes' intersection, a and b.
INTER = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
AREA_A, AREA_B = "((a.x1 - a.x0) * (a.y1 - a.y0))", "((b.x1 - b.x0) * (b.y1 - b.y0))"
MEET = "a.page = b.page AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
CENTRED = "(b.x0 + b.x1 BETWEEN 2 * a.x0 AND 2 * a.x1 AND b.y0 + b.y1 BETWEEN 2 * a.y0 AND 2 * a.y1)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)


# joins of boxes (JOIN, GEO17-19)


def merged_sql(first: str, rest: str, out: str, width: int) -> str:
    """Common table expressions of the primary rows and of the others that match none of them."""
    lines = f"greatest(1, a.y1 - a.y0) <= 2.2::DOUBLE * m AND greatest(1, a.x1 - a.x0) <= 0.98::DOUBLE * {width} AND greatest(1, b.y1 - b.y0) <= 2.6::DOUBLE * m"
    near = "(b.x0 + b.x1) / 2 BETWEEN a.x0 - 2 AND a.x1 + 2 AND (b.y0 + b.y1) / 2 BETWEEN a.y0 - 2 AND a.y1 + 2"
    return f"""{out}_line AS (SELECT page, greatest(4.0::DOUBLE, list_sort(list(greatest(1, y1 - y0)))[count(*) // 2 + 1]) AS m FROM {first} GROUP BY page), {out} AS (SELECT * FROM {first} UNION ALL SELECT * FROM ({rest}) b WHERE NOT EXISTS (
  SELECT 1 FROM {first} a JOIN {out}_line l ON a.page = l.page WHERE a.page = b.page AND ({INTER} / greatest(1, {AREA_A} + {AREA_B} - {INTER}) >= 0.45 OR {INTER} / least({AREA_A}, {AREA_B}) >= 0.85 OR ({lines} AND {near}))))"""


@query("q_merge_primary", f"""WITH {BOXES}, prime AS (SELECT * FROM boxes WHERE provider = 'A'), {merged_sql("prime", "SELECT * FROM boxes WHERE provider <> 'A'", "kept", 960)}
  SELECT page, pos, x0, y0, x1, y1, row_number() OVER (PARTITION BY page ORDER BY y0 + y1, x0, pos) AS rank FROM kept""")
def _merge(s, d):
    return layout.reading_order(layout.merge_primary(boxes(s, d), F.col("provider") == "A", 960)).select(*layout.BOX, "rank")


@query("q_merge_in_turn", f"""WITH {BOXES}, prime AS (SELECT * FROM boxes WHERE provider = 'A'), {merged_sql("prime", "SELECT * FROM boxes WHERE provider = 'N'", "two", 960)}, {merged_sql("two", "SELECT * FROM boxes WHERE provider = 'R'", "three", 960)} SELECT page, pos, provider FROM three""")
def _in_turn(s, d):
    return layout.merge_in_turn(boxes(s, d), "provider", ("A", "N", "R"), 960).select("page", "pos", "provider")


@query("q_box_pairs", f"""WITH {BOXES}, p AS (SELECT a.page, a.pos AS a, b.pos AS b, {INTER} AS inter, {INTER} / greatest(1, {AREA_A} + {AREA_B} - {INTER}) AS iou, {INTER} / least({AREA_A}, {AREA_B}) AS cover FROM boxes a JOIN boxes b ON {MEET} AND a.pos < b.pos)
  SELECT page, count(*) AS pairs, CAST(sum(inter) AS BIGINT) AS inter, max(iou) AS iou, max(cover) AS cover FROM p GROUP BY page""")
def _pairs(s, d):
    return layout.pairs(boxes(s, d)).groupBy("page").agg(F.count("*").alias("pairs"), F.sum("inter").alias("inter"), F.max("iou").alias("iou"), F.max("cover").alias("cover"))


@query("q_box_overlap_stats", f"""WITH {BOXES}, {REGIONS} SELECT a.page, a.region, count(b.pos) AS overlapping, CAST(coalesce(sum(CASE WHEN b.pos IS NOT NULL AND {CENTRED} THEN 1 ELSE 0 END), 0) AS BIGINT) AS centred,
  CAST(least(sum(CASE WHEN b.pos IS NULL THEN 0 ELSE {INTER} END), {AREA_A}) AS BIGINT) AS covered FROM regions a LEFT JOIN boxes b ON {MEET} GROUP BY a.page, a.region, {AREA_A}""")
def _region_stats(s, d):
    return layout.region_stats(regions(s, d), boxes(s, d))


@query("q_suppress", f"""WITH {BOXES}, {REGIONS} SELECT page, pos, x0, y0, x1, y1 FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM regions a WHERE {MEET} AND ({INTER} / {AREA_B} >= 0.86 OR ({CENTRED} AND {INTER} / {AREA_B} >= 0.5)))""")
def _suppress(s, d):
    return layout.suppressed(boxes(s, d), regions(s, d)).select(*layout.BOX)


@query("q_exists_fragment", f"""WITH {BOXES}, {REGIONS} SELECT page, region, x0, y0, x1, y1 FROM regions a WHERE EXISTS (SELECT 1 FROM boxes b WHERE {MEET} AND {INTER} / least({AREA_A}, {AREA_B}) >= 0.5)""")
def _exists(s, d):
    return layout.explained(regions(s, d), boxes(s, d))


@query("q_best_match", f"""WITH {BOXES}, {REGIONS}, p AS (SELECT a.page, a.region, b.pos, {INTER} / greatest(1, {AREA_A} + {AREA_B} - {INTER}) AS iou, {INTER} / greatest(1, {AREA_A}) AS own, {INTER} / greatest(1, {AREA_B}) AS other FROM regions a JOIN boxes b ON {MEET})
  SELECT page, region, pos, score FROM (SELECT *, greatest(iou, own, other) AS score, row_number() OVER (PARTITION BY page, region ORDER BY greatest(iou, own, other) DESC, pos) AS k FROM p WHERE iou >= 0.52 OR own >= 0.72 OR other >= 0.72) WHERE k = 1""")
def _best(s, d):
    return layout.best_match(regions(s, d), boxes(s, d))


@query("q_grid_cells", f"""WITH {BOXES}, {REGIONS}, n AS (SELECT a.page, a.region, least(3 * (b.y0 + b.y1 - 2 * a.y0) // (2 * (a.y1 - a.y0)), 2) AS r, least(4 * (b.x0 + b.x1 - 2 * a.x0) // (2 * (a.x1 - a.x0)), 3) AS c, count(*) AS n FROM regions a JOIN boxes b ON a.page = b.page AND {CENTRED} GROUP BY ALL)
  SELECT a.page, a.region, g.r, h.c, coalesce(n.n, 0) AS n FROM regions a CROSS JOIN (SELECT unnest([0, 1, 2])::BIGINT AS r) g CROSS JOIN (SELECT unnest([0, 1, 2, 3])::BIGINT AS c) h LEFT JOIN n ON a.page = n.page AND a.region = n.region AND g.r = n.r AND h.c = n.c""")
def _grid(s, d):
    return layout.grid_cells(regions(s, d), boxes(s, d), 3, 4)


@query("q_page_sizes", f"""WITH {BOXES}, {REGIONS}, sizes AS (SELECT page, max(x1) FILTER (region % 3 = 0) AS width, max(y1) AS height FROM regions GROUP BY page)
  SELECT b.page, count(*) AS n, CAST(coalesce(max(s.width), 960) AS BIGINT) AS width, CAST(coalesce(max(s.height), 540) AS BIGINT) AS height FROM boxes b LEFT JOIN sizes s ON b.page + 1 = s.page WHERE b.page >= 1 GROUP BY b.page""")
def _page_sizes(s, d):
    sizes = regions(s, d).groupBy("page").agg(F.max(F.when(F.col("region") % 3 == 0, F.col("x1"))).alias("width"), F.max("y1").alias("height"))
    shifted = sizes.select((F.col("page") - 1).alias("page"), "width", "height")
    joined = boxes(s, d).where("page >= 1").groupBy("page").agg(F.count("*").alias("n")).join(shifted, "page", "left")
    return joined.select("page", "n", F.coalesce("width", F.lit(960)).cast("long").alias("width"), F.coalesce("height", F.lit(540)).cast("long").alias("height"))


@query("q_page_diff", f"""WITH {BOXES}, l AS (SELECT page, CAST(sum(x0) AS BIGINT) AS before FROM boxes GROUP BY page), r AS (SELECT CASE WHEN page % 11 = 0 THEN -1 - page ELSE page END AS page, CAST(sum(CASE WHEN page % 5 = 0 THEN x0 + 1 ELSE x0 END) AS BIGINT) AS after FROM boxes GROUP BY 1)
  SELECT coalesce(l.page, r.page) AS page, before, after FROM l FULL JOIN r ON l.page = r.page WHERE before IS DISTINCT FROM after""")
def _diff(s, d):
    left = boxes(s, d).groupBy("page").agg(F.sum("x0"))
    moved = F.when(F.col("page") % 11 == 0, -1 - F.col("page")).otherwise(F.col("page"))
    right = boxes(s, d).withColumn("x0", F.when(F.col("page") % 5 == 0, F.col("x0") + 1).otherwise(F.col("x0"))).groupBy(moved.alias("page")).agg(F.sum("x0"))
    return layout.page_diff(left, right)



# geometry projections (GEO)


@query("q_coerce", f"WITH {BOXES} SELECT page, pos, CASE WHEN pos % 9 <> 0 THEN CAST(least(x1, x0) AS DOUBLE) END AS x0, CASE WHEN pos % 9 <> 0 THEN CAST(greatest(y1, y0) AS DOUBLE) END AS y1 FROM boxes")
def _coerce(s, d):
    bad = F.when(F.col("pos") % 9 != 0, F.col("x1").cast("double")).when(F.col("pos") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return boxes(s, d).select("page", "pos", geo.coerce(bad, F.col("y1"), F.col("x0"), F.col("y0")).alias("b")).select("page", "pos", "b.x0", "b.y1")


@query("q_pixels", f"WITH {BOXES} SELECT page, pos, least(greatest(CAST(round_even(x0 * (1500.0::DOUBLE / 960.0::DOUBLE), 0) AS BIGINT), 0), 1499) AS px0, least(greatest(CAST(round_even(x1 * (1500.0::DOUBLE / 960.0::DOUBLE), 0) AS BIGINT), 0), 1500) AS px1 FROM boxes")
def _pixels(s, d):
    return boxes(s, d).select("page", "pos", geo.to_pixels(F.col("x0"), 960.0, 1500, 1499).alias("px0"), geo.to_pixels(F.col("x1"), 960.0, 1500, 1500).alias("px1"))


@query("q_emu", f"WITH {BOXES} SELECT page, pos, CAST(round_even(x0 * 9525.5::DOUBLE + 100.25::DOUBLE, 0) AS BIGINT) AS left_emu, greatest(0, CAST(round_even((x1 - x0) * 9525.5::DOUBLE, 0) AS BIGINT)) AS width_emu FROM boxes")
def _emu(s, d):
    return boxes(s, d).select("page", "pos", geo.to_emu(F.col("x0"), 9525.5, 100.25).alias("left_emu"), F.greatest(F.lit(0), geo.to_emu(F.col("x1") - F.col("x0"), 9525.5, 0.0)).cast("long").alias("width_emu"))


@query("q_colour", "SELECT o_orderkey AS id, '#' || lpad(lower(to_hex((o_orderkey * 7919) & 16777215)), 6, '0') AS colour, 2126 * (((o_orderkey * 7919) >> 16) & 255) + 7152 * (((o_orderkey * 7919) >> 8) & 255) + 722 * ((o_orderkey * 7919) & 255) AS luma FROM orders")
def _colour(s, d):
    number = F.col("o_orderkey") * 7919
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), geo.hex_colour(number).alias("colour"), geo.luma(number).cast("long").alias("luma"))


# filters over pages (FLT, SORT, SET, WIN)


@query("q_multi_column", f"""WITH {BOXES}, p AS (SELECT *, x0 + x1 < 0.9 * 1000 AS l, x0 + x1 > 1.1 * 1000 AS r FROM boxes),
  g AS (SELECT page, count(*) AS n, CAST(sum(l::INT) AS BIGINT) AS "left", CAST(sum(r::INT) AS BIGINT) AS "right", least(max(y1) FILTER (l), max(y1) FILTER (r)) - greatest(min(y0) FILTER (l), min(y0) FILTER (r)) AS o FROM p GROUP BY page) SELECT page, n, "left", "right" FROM g WHERE n >= 8 AND "left" >= 3 AND "right" >= 3 AND o > 70""")
def _columns(s, d):
    return layout.multi_column(boxes(s, d), 1000)


@query("q_layout_order", f"WITH {BOXES} SELECT page, pos, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN confidence % 3 <> 0 THEN confidence END NULLS LAST, y0, x0, pos) AS rank FROM boxes")
def _layout_order(s, d):
    given = F.when(F.col("confidence") % 3 != 0, F.col("confidence"))
    return layout.layout_order(boxes(s, d).withColumn("given", given), "given").select("page", "pos", "rank")


@query("q_first_regions", f"WITH {REGIONS} SELECT page, region FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY region) AS k FROM regions WHERE region * 7 % 60 >= 24) WHERE k <= 12")
def _first_regions(s, d):
    sized = regions(s, d).withColumn("x1", F.col("x0") + F.col("region") * 7 % 60)
    return listing_ops.numbered(sized.where("x1 - x0 >= 24"), "page", "region").where("number < 12").select("page", "region")


@query("q_exact_dedup", f"WITH {BOXES} SELECT page, pos, confidence, provider FROM (SELECT *, row_number() OVER (PARTITION BY page, confidence, provider ORDER BY pos) AS k FROM boxes) WHERE k = 1")
def _exact(s, d):
    return layout.first_of(boxes(s, d), "page", "confidence", "provider").select("page", "pos", "confidence", "provider")


@query("q_x_segments", f"""WITH {BOXES}, f AS (SELECT *, y0 // 40 AS "row", CASE WHEN x0 - lag(x1) OVER (PARTITION BY page, y0 // 40 ORDER BY x0, pos) > 30 THEN 1 ELSE 0 END AS fresh FROM boxes),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY page, "row" ORDER BY x0, pos ROWS UNBOUNDED PRECEDING) AS segment FROM f) SELECT page, "row", CAST(segment AS BIGINT) AS segment, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g GROUP BY page, "row", segment""")
def _segments(s, d):
    rows = boxes(s, d).withColumn("row", F.expr("y0 div 40"))
    return layout.envelope(layout.x_segments(rows, 30), "page", "row", "segment")


@query("q_greedy_dedup", None)
def _greedy(s, d):
    return layout.greedy_dedup(boxes(s, d))


# aggregates (AGG)


@query("q_upper_median", f"WITH {BOXES} SELECT page, h AS median FROM (SELECT page, y1 - y0 AS h, row_number() OVER (PARTITION BY page ORDER BY y1 - y0, pos) AS k, count(*) OVER (PARTITION BY page) AS n FROM boxes) WHERE k = n // 2 + 1")
def _upper(s, d):
    return layout.ordered_value(["page"], "h", layout.upper_median(), "median", boxes(s, d).withColumn("h", F.col("y1") - F.col("y0")))


@query("q_nearest_rank", f"WITH {BOXES} SELECT page, h AS p90 FROM (SELECT page, y1 - y0 AS h, row_number() OVER (PARTITION BY page ORDER BY y1 - y0, pos) AS k, count(*) OVER (PARTITION BY page) AS n FROM boxes) WHERE k = CAST(round_even((n - 1) * 0.9::DOUBLE, 0) AS BIGINT) + 1")
def _rank(s, d):
    return layout.ordered_value(["page"], "h", layout.nearest_rank(0.9), "p90", boxes(s, d).withColumn("h", F.col("y1") - F.col("y0")))


@query("q_weighted_quantile", f"""WITH {BOXES}, b AS (SELECT page, pos, x1 - x0 AS w, 2 * (y1 - y0) + CASE WHEN page % 4 = 1 THEN 90 ELSE -20 END AS h FROM boxes), s AS (SELECT *, count(*) OVER (PARTITION BY page) AS n, row_number() OVER (PARTITION BY page ORDER BY w DESC, pos) AS k FROM b WHERE w > 0 AND h BETWEEN 4.5 AND 96),
  t AS (SELECT page, h, pos, greatest(least(300, w) * least(300, w), 9) AS weight FROM s WHERE n <= 24 OR k <= greatest(12, round_even(n * 0.25::DOUBLE, 0))),
  u AS (SELECT page, h, sum(weight) OVER (PARTITION BY page ORDER BY h, pos ROWS UNBOUNDED PRECEDING) AS upto, sum(weight) OVER (PARTITION BY page) AS total FROM t), f AS (SELECT page, least(greatest(min(h)::DOUBLE, 6), 48) AS size FROM u WHERE upto >= 0.6::DOUBLE * total GROUP BY page)
  SELECT p.page, coalesce(size, 12) AS size FROM (SELECT DISTINCT page FROM boxes) p LEFT JOIN f ON p.page = f.page""")
def _weighted(s, d):
    tall = F.when(F.col("page") % 4 == 1, 90).otherwise(-20)
    return layout.weighted_quantile(boxes(s, d).withColumn("y1", F.col("y0") + 2 * (F.col("y1") - F.col("y0")) + tall), 300)


@query("q_union_box", f"WITH {BOXES} SELECT page, provider, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY page, provider")
def _union(s, d):
    return layout.envelope(boxes(s, d), "page", "provider")


@query("q_provider_summary", f"WITH {BOXES} SELECT page, count(*) AS n, count(*) FILTER (confidence < 3) AS weak, count(DISTINCT provider) AS providers FROM boxes GROUP BY page")
def _summary(s, d):
    return boxes(s, d).groupBy("page").agg(F.count("*").alias("n"), F.count(F.when(F.col("confidence") < 3, 1)).alias("weak"), F.count_distinct("provider").alias("providers"))


# texts (STR, FLT)


@query("q_token_estimate", "SELECT doc_id, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens, length(regexp_replace(text, '\\s', '', 'g')) AS compact FROM documents")
def _estimate(s, d):
    return table(s, d, "documents").select("doc_id", txt.token_estimate(F.col("text")).alias("tokens"), txt.compact_length(F.col("text")).cast("long").alias("compact"))


@query("q_labels", "SELECT event_id, regexp_replace(lower(trim(' ' || event_type || ' - X_ ')), '[\\s_-]+', '_', 'g') AS label, trim(regexp_replace('Bearer  ' || event_type, '^bearer\\s+', '', 'i')) AS token FROM events")
def _labels(s, d):
    return table(s, d, "events").select("event_id", txt.label(F.concat(F.lit(" "), "event_type", F.lit(" - X_ "))).alias("label"), txt.bearer(F.concat(F.lit("Bearer  "), "event_type")).alias("token"))


@query("q_markdown", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, trim(replace(replace(regexp_replace(regexp_replace(regexp_replace(line, '^\\s{0,3}#{1,6}\\s+', ''), '^\\s*[-*+]\\s+', ''), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '`', ''), '**', ''), ' ') AS line FROM l)
  SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM c WHERE line <> '' GROUP BY doc_id""")
def _markdown(s, d):
    lines = table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    cleaned = lines.select("doc_id", txt.markdown_line(F.col("line")).alias("line")).where("line <> ''")
    return cleaned.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("q_cjk", "SELECT id, t, regexp_matches(t, '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]') AS cjk FROM (VALUES (1, 'abc'), (2, '中文'), (3, 'カナ x'), (4, '한글'), (5, 'é'), (6, NULL)) v(id, t)")
def _cjk(s, d):
    rows = s.createDataFrame([(1, "abc"), (2, "中文"), (3, "カナ x"), (4, "한글"), (5, "é"), (6, None)], "id int, t string")
    return rows.select("id", "t", txt.has_cjk(F.col("t")).alias("cjk"))


@query("q_conversation_join", "SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || length(text), chr(10) ORDER BY turn) AS outline FROM conversations GROUP BY conv_id")
def _conversations(s, d):
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("t"))
    line = F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["n"].cast("string")))
    return turns.select("conv_id", F.size("t").cast("long").alias("turns"), F.array_join(line, "\n").alias("outline"))


@query("q_char_classes", "SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[^.,;:!?]', '', 'g')) AS marks FROM documents")
def _classes(s, d):
    return table(s, d, "documents").select("doc_id", *(F.length(F.regexp_replace("text", p, "")).cast("long").alias(n) for n, p in (("letters", "[^A-Za-z]"), ("digits", "[^0-9]"), ("marks", "[^.,;:!?]"))))


URLS = ["http://localhost:8000/v1", "https://localhost.example.org/", "http://0.0.0.0", "http://[::1]:80/x", "https://nas.local/a", "http://user@10.1.2.3/", "http://10.example.com:", "https://172.16.0.1", "https://172.32.0.1", "http://172.x.1", "http://192.168.1.1:11434/v1", "127.0.0.1", None, "", "https://api.example.com/10.1"]


@query("q_hosts", f"""WITH u AS (SELECT page_id AS id, url FROM pages UNION ALL SELECT -i, [{", ".join("NULL" if u is None else f"'{u}'" for u in URLS)}][i] FROM range(1, {len(URLS) + 1}) t(i)),
  p AS (SELECT id, regexp_replace(regexp_extract(lower(coalesce(trim(url), '')), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '') AS p FROM u), h AS (SELECT id, CASE WHEN starts_with(p, '[') THEN regexp_extract(p, '^\\[([^\\]]*)\\]', 1) ELSE split_part(p, ':', 1) END AS host FROM p)
  SELECT id, host, host IN ('localhost', '127.0.0.1', '0.0.0.0', '::1') OR host LIKE '%.local' OR host LIKE '10.%' OR host LIKE '192.168.%' OR (host LIKE '172.%' AND coalesce(TRY_CAST(split_part(host, '.', 2) AS INT), -1) BETWEEN 16 AND 31) AS private FROM h""")
def _hosts(s, d):
    extra = s.createDataFrame([(-i, u) for i, u in enumerate(URLS, 1)], "id long, url string")
    rows = table(s, d, "pages").select(F.col("page_id").alias("id"), "url").unionByName(extra)
    return rows.select("id", scalars.host(F.col("url")).alias("host"), scalars.private_host(F.col("url")).alias("private"))


TEXTS = ["\u3000a\u00a0 b\u3000", "\u3000", "", None, "x\u2003y", "\u0085z\t", "A-b C", "ab c", "中\u3000文 1"]


@query("q_clean_texts", "WITH t AS (SELECT i AS id, [" + ", ".join("NULL" if t is None else f"'{t}'" for t in TEXTS) + f"""][i] AS t FROM range(1, {len(TEXTS) + 1}) r(i)), c AS (SELECT *, lower(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS d FROM t)
  SELECT id, nullif(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '') AS clean, nullif(trim(regexp_replace(t, '\\s+', ' ', 'g')), '') AS cleaned, length(regexp_replace(t, '\\s', '', 'g')) AS compact, d AS deduped,
  d = 'abc' OR ((contains(d, 'abc') OR contains('abc', d)) AND least(length(d), 3) >= 3 AND least(length(d), 3) >= 0.65 * greatest(length(d), 3)) AS alike FROM c""")
def _clean_texts(s, d):
    rows = s.createDataFrame(list(enumerate(TEXTS, 1)), "id long, t string")
    t = F.col("t")
    return rows.select("id", txt.clean(t).alias("clean"), txt.cleaned(t).alias("cleaned"), txt.compact_length(t).cast("long").alias("compact"), txt.for_dedup(t).alias("deduped"), txt.similar(txt.for_dedup(t), F.lit("abc")).alias("alike"))



# job events (WIN21-23, STRM, AGG18-19, SORT05, JOIN13-14)


@query("q_changes", f"WITH {EVENTS} SELECT job, event_id, status FROM (SELECT *, lag(status) OVER w AS before, lag(event_id) OVER w AS one FROM ev WINDOW w AS (PARTITION BY job ORDER BY ts, event_id)) WHERE one IS NULL OR status IS DISTINCT FROM before")
def _changes(s, d):
    return ev.changes(job_events(s, d), "status").select("job", "event_id", "status")


@query("q_event_log", f"WITH {EVENTS}, f AS (SELECT *, event_id % 2 AS level, lag(status) OVER w AS s, lag(progress) OVER w AS p, lag(event_id % 2) OVER w AS l, lag(event_id) OVER w AS one FROM ev WINDOW w AS (PARTITION BY job ORDER BY ts, event_id)), k AS (SELECT * FROM f WHERE one IS NULL OR status IS DISTINCT FROM s OR level IS DISTINCT FROM l OR (progress // 50) IS DISTINCT FROM (p // 50)) SELECT job, event_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS seq, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS back FROM k) WHERE back <= 20")
def _log(s, d):
    events = job_events(s, d).withColumns({"level": F.col("event_id") % 2, "half": F.expr("progress div 50")})
    return ev.logged(events, 5, "status", "level", "half").select("job", "event_id", "seq")


@query("q_latest", f"WITH {EVENTS} SELECT job, event_id, status, progress FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS k FROM ev) WHERE k = 1")
def _latest(s, d):
    return ev.latest(job_events(s, d)).select("job", "event_id", "status", "progress")


@query("q_progress", f"WITH {EVENTS} SELECT job, event_id, max(least(progress, 99)) OVER (PARTITION BY job ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS shown FROM ev")
def _progress(s, d):
    return ev.monotone_progress(job_events(s, d)).select("job", "event_id", "shown")


@query("q_until_terminal", f"WITH {EVENTS} SELECT job, event_id FROM (SELECT *, coalesce(max((status = 'purchase')::INT) OVER (PARTITION BY job ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM ev) WHERE seen = 0")
def _terminal(s, d):
    return ev.until_terminal(job_events(s, d), "purchase").select("job", "event_id")


@query("q_rate", f"""WITH RECURSIVE {EVENTS}, o AS (SELECT job, event_id, epoch_us(ts) AS t, least(1 + event_id % 40, 60) AS n, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS place FROM ev),
  r(job, place, event_id, kept, admitted) AS (SELECT DISTINCT job, 0::BIGINT, 0::BIGINT, CAST([] AS STRUCT(t BIGINT, n BIGINT)[]), false FROM o
    UNION ALL SELECT job, place, event_id, CASE WHEN fits THEN list_append(recent, {{'t': t, 'n': n}}) ELSE recent END, fits FROM (SELECT *, len(recent) < 3 AND coalesce(list_sum(list_transform(recent, lambda x: x.n)), 0) + n <= 60 AS fits FROM
      (SELECT o.job, o.place, o.event_id, o.t, o.n, list_filter(r.kept, lambda x: x.t >= o.t - 172800000000) AS recent FROM r JOIN o ON o.job = r.job AND o.place = r.place + 1)))
  SELECT job AS key, event_id, admitted FROM r WHERE place > 0""")
def _rate(s, d):
    return ev.admissions(job_events(s, d).withColumn("tokens", 1 + F.col("event_id") % 40), "job", 172_800, 3, 60)


@query("q_breaker", f"""WITH {EVENTS}, g AS (SELECT *, sum((status <> 'click')::INT) OVER (PARTITION BY job ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM ev)
  SELECT job, event_id, CAST(sum((status = 'click')::INT) OVER w AS BIGINT) AS run, sum((status = 'click')::INT) OVER w >= 2 AS open FROM g WINDOW w AS (PARTITION BY job, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def _breaker(s, d):
    return ev.breaker(job_events(s, d), "click", 2).select("job", "event_id", "run", "open")


@query("q_status_counts", f"WITH {EVENTS} SELECT status, count(*) AS n, count(DISTINCT job) AS jobs, CAST(sum(progress) AS BIGINT) AS progress FROM ev GROUP BY status")
def _status(s, d):
    return job_events(s, d).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("job").alias("jobs"), F.sum("progress").alias("progress"))


@query("q_newest_jobs", f"WITH {EVENTS} SELECT job, max(epoch_us(ts)) AS newest FROM ev GROUP BY job ORDER BY newest DESC, job LIMIT 50")
def _newest(s, d):
    return job_events(s, d).groupBy("job").agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("newest")).orderBy(F.desc("newest"), "job").limit(50)


@query("q_json_props", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, starts_with(props, '{') AS holds FROM events""")
def _json(s, d):
    props = F.col("props")
    value = F.try_variant_get(F.try_parse_json(props), "$.k", "bigint")
    return table(s, d, "events").select("event_id", value.alias("k"), F.startswith(props, F.lit("{")).alias("holds"))

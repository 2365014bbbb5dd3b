"""Queries of times, keys, lists, names, files and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import events as ev
from ..operators import layout, listing
from ..sources.tables import BOXES, EVENTS, REGIONS, boxes, job_events, regions, table
from .catalog import query

ORDERED = "o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS place FROM ev)"


def _values(rows) -> str:
    """Rows as a VALUES list of SQL."""
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _ordered_statuses(s, d):
    lists = job_events(s, d).groupBy("job").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "status"))).alias("e"))
    return lists.select("job", F.col("e.status").alias("statuses"))


@query("q_expiry", "SELECT event_id, epoch_us(ts) + greatest(event_id % 200, 60) * 1000000 AS expires FROM events")
def _expiry(s, d):
    return table(s, d, "events").select("event_id", sc.expires(F.col("ts"), F.col("event_id") % 200).alias("expires"))


TIMES = [(1, "2024-01-02T03:04:05"), (2, "2024-01-02T03:04:05+02:00"), (3, "2024-01-02T03:04:05Z"), (4, "2024-02-30T00:00:00"), (5, "no"), (6, None), (7, "2024-01-02T03:04:05.250"), (8, "2024-01-02T23:30:00-01:30")]


@query("q_utc_times", f"WITH v(id, t) AS (VALUES {_values(TIMES)}) SELECT id::BIGINT AS id, epoch_us(TRY_CAST(CASE WHEN regexp_matches(t, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') THEN t ELSE t || 'Z' END AS TIMESTAMPTZ)) AS at FROM v")
def _utc(s, d):
    return s.createDataFrame(TIMES, "id long, t string").select("id", sc.utc_micros(F.col("t")).alias("at"))


@query("q_iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS iso FROM events")
def _iso(s, d):
    return table(s, d, "events").select("event_id", sc.iso_millis(F.col("ts")).alias("iso"))


@query("q_elapsed", f"WITH {EVENTS} SELECT job, event_id, CAST(round_even(greatest(0.0::DOUBLE, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY job ORDER BY ts, event_id))) / 1e6::DOUBLE) * 1000, 0) AS BIGINT) AS millis FROM ev QUALIFY lag(ts) OVER (PARTITION BY job ORDER BY ts, event_id) IS NOT NULL")
def _elapsed(s, d):
    rows = job_events(s, d).withColumn("before", F.lag("ts").over(ev.in_time())).where("before is not null")
    return rows.select("job", "event_id", sc.elapsed_millis(F.col("before"), F.col("ts")).alias("millis"))


@query("q_limiter_keys", """SELECT page_id, CASE WHEN page_id % 5 = 0 AND page_id % 3 = 0 THEN NULL ELSE '{"api_key_hash": "' || left(sha1((page_id % 7)::VARCHAR), 12) || '", "base_url": "' || lower(trim(url)) || '", "model": "gpt \\"4\\"", "provider": "open", "rpm": ' ||
  CASE WHEN page_id % 5 = 0 THEN 'null' ELSE (page_id % 5)::VARCHAR END || ', "tpm": ' || CASE WHEN page_id % 3 = 0 THEN 'null' ELSE (1000 * (page_id % 3))::VARCHAR END || '}' END AS key FROM pages""")
def _limiter(s, d):
    n = F.col("page_id")
    key = sc.limiter_key((n % 7).cast("string"), F.lit(" Open "), F.col("url"), F.lit('GPT "4"'), F.when(n % 5 != 0, n % 5), F.when(n % 3 != 0, 1000 * (n % 3)))
    return table(s, d, "pages").select("page_id", key.alias("key"))


@query("q_match_texts", r"SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', '', 'g') AS matched FROM documents")
def _match(s, d):
    return table(s, d, "documents").select("doc_id", sc.for_match(F.col("text")).alias("matched"))


FONT_NAMES = [(1, "Helvetica"), (2, " Times-Roman "), (3, "Courier"), (4, "Inter"), (5, " "), (6, None), (7, "helvetica")]


@query("q_fonts", f"WITH v(id, t) AS (VALUES {_values(FONT_NAMES)}) SELECT id::BIGINT AS id, CASE trim(t) WHEN 'Helvetica' THEN 'Arial' WHEN 'Times-Roman' THEN 'Times New Roman' WHEN 'Courier' THEN 'Courier New' ELSE nullif(trim(t), '') END AS font FROM v")
def _fonts(s, d):
    return s.createDataFrame(FONT_NAMES, "id long, t string").select("id", sc.font(F.col("t")).alias("font"))


@query("q_first_suffix", f"WITH {EVENTS}, {ORDERED} SELECT job, arg_min(substr(status, 4), place) FILTER (WHERE starts_with(status, 'pur')) AS suffix FROM o GROUP BY job")
def _suffix(s, d):
    return _ordered_statuses(s, d).select("job", sc.suffix_of_first(F.col("statuses"), "pur").alias("suffix"))


@query("q_ordered_statuses", f"WITH {EVENTS}, {ORDERED}, f AS (SELECT job, status, min(place) AS place FROM o GROUP BY job, status) SELECT job, string_agg(status, '|' ORDER BY place) AS statuses FROM f GROUP BY job")
def _distinct(s, d):
    padded = F.transform("statuses", lambda x: F.concat(F.lit(" "), x, F.lit("  ")))
    return _ordered_statuses(s, d).select("job", F.array_join(sc.distinct_texts(F.concat(F.array(F.lit(" "), F.lit(None)), padded)), "|").alias("statuses"))


@query("q_optional_lists", f"WITH {EVENTS} SELECT job, CASE WHEN job % 4 = 0 THEN 0 ELSE count(*) END AS n FROM ev GROUP BY job")
def _optional(s, d):
    return _ordered_statuses(s, d).select("job", F.size(sc.or_empty(F.when(F.col("job") % 4 != 0, F.col("statuses")))).cast("long").alias("n"))


PAGE_LISTS = [(1, ["3", "1", "2", "1"]), (2, ["x", "-1", "7", "nan"]), (3, ["0", "10", "9", None]), (4, ["4.0", "4", "inf"])]


@query("q_page_numbers", "WITH v AS (" + " UNION ALL ".join(f"SELECT {i} AS id, unnest([{', '.join('NULL' if x is None else repr(x) for x in xs)}]) AS x" for i, xs in PAGE_LISTS) + "), n AS (SELECT DISTINCT id, TRY_CAST(x AS DOUBLE) AS n FROM v) SELECT id::BIGINT AS id, string_agg(CAST(n AS BIGINT)::VARCHAR, ',' ORDER BY n) AS pages FROM n WHERE n >= 0 AND isfinite(n) GROUP BY id")
def _page_numbers(s, d):
    rows = s.createDataFrame(PAGE_LISTS, "id long, v array<string>")
    return rows.select("id", F.array_join(F.transform(sc.page_numbers(F.col("v")), lambda n: n.cast("long").cast("string")), ",").alias("pages"))


@query("q_missing_names", "SELECT c_nationkey AS nation, array_to_string(list_filter(['building', 'Machinery', 'absent', 'HOUSEHOLD'], lambda x: NOT list_contains(list_transform(list(DISTINCT c_mktsegment), lambda y: lower(y)), lower(x))), ',') AS missing FROM customer GROUP BY c_nationkey")
def _missing(s, d):
    wanted = F.array(*[F.lit(x) for x in ("building", "Machinery", "absent", "HOUSEHOLD")])
    sets = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.collect_set("c_mktsegment").alias("there"))
    return sets.select("nation", F.array_join(sc.missing(wanted, F.col("there")), ",").alias("missing"))


@query("q_overlay", f"WITH {BOXES}, {REGIONS}, l AS (SELECT page, max(x1) AS width FROM regions GROUP BY page), r AS (SELECT page, max(x1) FILTER (provider = 'A') AS width FROM boxes GROUP BY page) SELECT coalesce(l.page, r.page) AS page, coalesce(r.width, l.width) AS width FROM l FULL JOIN r ON l.page = r.page")
def _overlay(s, d):
    left = regions(s, d).groupBy("page").agg(F.max("x1").alias("width"))
    right = boxes(s, d).groupBy("page").agg(F.max(F.when(F.col("provider") == "A", F.col("x1"))).alias("width"))
    return listing.overlaid(left, right, "page")


@query("q_residual", f"WITH {BOXES}, {REGIONS} SELECT page, pos FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM regions a WHERE a.page = b.page AND b.x0 + b.x1 BETWEEN 2 * a.x0 AND 2 * a.x1 AND b.y0 + b.y1 BETWEEN 2 * a.y0 AND 2 * a.y1)")
def _residual(s, d):
    return layout.residual(boxes(s, d), regions(s, d)).select("page", "pos")


@query("q_manifest", "SELECT user_id AS job, count(*) AS images, count(DISTINCT event_type) AS kinds, array_to_string(list_sort(list(DISTINCT event_id % 17)), ',') AS pages FROM events GROUP BY user_id")
def _manifest(s, d):
    images = table(s, d, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("kind"), (F.col("event_id") % 17).alias("page"))
    return listing.manifest(images).select("job", "images", "kinds", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


FILES = [
    ("a", "x/content_list.json"), ("a", "x/y/content_list.json"), ("a", "x/my_content_list.json"), ("b", "deep/er/One_Content_List.json"), ("b", "z_content_list.json"), ("b", "b_content_list.json"),
    ("c", "out/content_list_v2.json"), ("c", "out/other.json"), ("d", "layout.json"), ("d", "content_list.txt"), ("e", "pages/page-0003.png"), ("e", "pages/page-0001.png"), ("e", "pages/page-x.png"), ("e", "other/page-0002.png"), ("e", "pages/page-0004.jpg"), ("f", "pages/page-0010.png.png"),
]


@query("q_json_files", f"""WITH v(root, path) AS (VALUES {_values(FILES)}), n AS (SELECT *, lower(regexp_extract(path, '[^/]+$')) AS name FROM v WHERE path LIKE '%.json'), r AS (SELECT *, CASE WHEN name = 'content_list.json' THEN 0 WHEN name LIKE '%\\_content\\_list.json' ESCAPE '\\' THEN 1 WHEN contains(name, 'content_list') THEN 2 END AS rank FROM n)
  SELECT root, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY rank, length(path), path) AS k FROM r WHERE rank IS NOT NULL) WHERE k = 1""")
def _json_files(s, d):
    return listing.find_json(s.createDataFrame(FILES, "root string, path string"), "content_list.json", "_content_list.json", "content_list")


@query("q_page_images", f"""WITH v(root, path) AS (VALUES {_values(FILES)}) SELECT root, path, CAST(regexp_extract(path, '^pages/page-([0-9]{{4}}).*[.]png$', 1) AS BIGINT) AS page FROM v WHERE regexp_matches(path, '^pages/page-[0-9]{{4}}[^/]*[.]png$')""")
def _page_images(s, d):
    return listing.page_images(s.createDataFrame(FILES, "root string, path string"), "pages", "page-([0-9]{4})")


UPLOADS = [(1, "a.PNG", None), (2, "a.pdf", "image/png; q=1"), (3, "a", "application/pdf"), (4, "b.webp", "text/plain"), (5, "c.PDF", ""), (6, "d.gif", None), (7, None, " IMAGE/JPEG "), (8, ".pdf", None)]


@query("q_upload_kinds", f"""WITH v(id, name, kind) AS (VALUES {_values(UPLOADS)}), k AS (SELECT id, lower(trim(split_part(coalesce(kind, ''), ';', 1))) AS kind, lower(regexp_extract(coalesce(name, ''), '[^/][.]([^./]+)$', 1)) AS suffix FROM v)
  SELECT id::BIGINT AS id, CASE WHEN kind IN ('image/png', 'image/jpeg', 'image/webp') THEN 'image' WHEN kind = 'application/pdf' THEN 'pdf' WHEN suffix IN ('png', 'jpg', 'jpeg', 'webp') THEN 'image' WHEN suffix = 'pdf' THEN 'pdf' END AS upload FROM k""")
def _uploads(s, d):
    return s.createDataFrame(UPLOADS, "id long, name string, kind string").select("id", sc.upload_kind(F.col("name"), F.col("kind")).alias("upload"))


PATHS = [(1, "a/b.png"), (2, "/etc/x"), (3, "a/../b"), (4, "..a/b"), (5, ".."), (6, None), (7, ""), (8, "a/..b/c")]


@query("q_safe_paths", f"WITH v(id, p) AS (VALUES {_values(PATHS)}) SELECT id::BIGINT AS id, coalesce(p <> '' AND NOT starts_with(p, '/') AND NOT list_contains(string_split(p, '/'), '..'), false) AS safe FROM v")
def _paths(s, d):
    return s.createDataFrame(PATHS, "id long, p string").select("id", sc.inside(F.col("p")).alias("safe"))


@query("q_job_keys", "WITH k AS (SELECT CASE event_id % 4 WHEN 0 THEN 'job:' WHEN 1 THEN 'job:' WHEN 2 THEN 'lock:' ELSE 'job:' END || event_id || CASE WHEN event_id % 4 = 3 THEN ':cancel' ELSE '' END AS key FROM events) SELECT substr(key, 5) AS id FROM k WHERE starts_with(key, 'job:') AND NOT contains(key, ':cancel')")
def _keys(s, d):
    n = F.col("event_id")
    key = F.concat(F.when(n % 4 == 2, "lock:").otherwise("job:"), n.cast("string"), F.when(n % 4 == 3, ":cancel").otherwise(""))
    return listing.job_keys(table(s, d, "events").select(key.alias("key")))


@query("q_cancelled", f"WITH {EVENTS}, j AS (SELECT job, arg_max(status, (ts, event_id)) AS status FROM ev GROUP BY job), f AS (SELECT DISTINCT c_custkey AS job FROM customer WHERE c_acctbal < 0) SELECT j.job, status, f.job IS NOT NULL AND status IN ('view', 'click') AS cancelled FROM j LEFT JOIN f ON j.job = f.job")
def _cancelled(s, d):
    flags = table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("job"))
    return listing.cancellable(ev.latest(job_events(s, d)).select("job", "status"), flags, ("view", "click"))


@query("q_job_filter", "SELECT event_id FROM events WHERE event_type = 'click' AND (contains(event_id::VARCHAR, '7') OR contains(lower(props), '7'))")
def _job_filter(s, d):
    jobs = table(s, d, "events").select("event_id", F.col("event_id").cast("string").alias("job_id"), F.col("event_type").alias("status"), F.col("props").alias("stage"))
    return listing.matching_jobs(jobs, "click", " 7 ").select("event_id")


@query("q_page_range", f"WITH {BOXES} SELECT page, count(*) AS n FROM boxes WHERE page BETWEEN 2 AND 8 GROUP BY page")
def _page_range(s, d):
    return listing.in_pages(boxes(s, d), 3, 9).groupBy("page").agg(F.count("*").alias("n"))


@query("q_suggestions", """WITH f AS (SELECT lower(trim(p_name)) AS key, min(p_partkey) AS pos FROM part WHERE trim(p_name) <> '' GROUP BY ALL), n AS (SELECT f.*, p.p_name AS name FROM f JOIN part p ON p.p_partkey = f.pos), r AS (SELECT *, CASE WHEN starts_with(key, 'part_1') THEN 0 WHEN contains(key, 'part_1') THEN 1 END AS rank FROM n), m AS (SELECT *, count(rank) OVER () AS hits FROM r)
  SELECT name, row_number() OVER (ORDER BY coalesce(rank, 2), pos) AS place FROM m WHERE rank IS NOT NULL OR hits = 0 ORDER BY place LIMIT 16""")
def _suggestions(s, d):
    return listing.suggestions(table(s, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name")), " Part_1")


@query("q_chunks", "SELECT o_orderkey AS id, (row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) - 1) // 80 AS chunk FROM orders")
def _chunks(s, d):
    rows = table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("part"))
    return listing.chunked(rows, ["part"], ["o_orderkey"]).select(F.col("o_orderkey").alias("id"), "chunk")


@query("q_numbered", f"WITH {REGIONS} SELECT page, region, row_number() OVER (PARTITION BY page ORDER BY region) - 1 AS number FROM regions")
def _numbered(s, d):
    return listing.numbered(regions(s, d), "page", "region").select("page", "region", "number")


#: The time at which folders are looked at, and how long they may stay.
NOW, STAY = "2024-01-20 00:00:00", 86_400

EXPIRED = f"""{EVENTS}, j AS (SELECT job, arg_max(status, (ts, event_id)) AS status, max(ts) + INTERVAL 1 DAY AS expires_at FROM ev GROUP BY job), f AS (SELECT DISTINCT c_custkey AS dir, TIMESTAMP '2024-01-18 00:00:00' + to_hours(CAST(c_custkey % 48 AS INT)) AS mtime FROM customer),
  g AS (SELECT dir, coalesce(CASE WHEN job IS NULL THEN mtime <= TIMESTAMP '{NOW}' - INTERVAL 1 DAY ELSE status IN ('purchase', 'view') AND expires_at <= TIMESTAMP '{NOW}' END, false) AS gone FROM f LEFT JOIN j ON dir = job)"""


def _expired(s, d):
    events = job_events(s, d)
    last = ev.latest(events).select("job", "status", (F.col("ts") + F.expr("interval 1 day")).alias("expires_at"))
    hours = F.make_dt_interval(hours=(F.col("c_custkey") % 48).cast("int"))
    folders = table(s, d, "customer").select(F.col("c_custkey").alias("dir"), (F.lit("2024-01-18 00:00:00").cast("timestamp_ntz") + hours).alias("mtime")).distinct()
    return listing.expired(folders, last, F.lit(NOW).cast("timestamp_ntz"), STAY, ("purchase", "view"))


@query("q_expired", f"WITH {EXPIRED} SELECT dir, gone FROM g")
def _expired_folders(s, d):
    return _expired(s, d)


@query("q_cleanup_stats", f"WITH {EXPIRED} SELECT count(*) AS scanned, count(*) FILTER (gone) AS deleted FROM g")
def _cleanup(s, d):
    return listing.cleanup_stats(_expired(s, d))


def _messages_sql() -> str:
    return "CASE " + " ".join(f"WHEN contains(w, '{mark}') THEN '{said}'" for mark, said in listing.MESSAGES) + " END"


MARKS = [mark for mark, _ in listing.MESSAGES] + ["other"]


@query("q_user_messages", f"""WITH {EVENTS}, {ORDERED}, w AS (SELECT job, place, 'page 3: ' || [{", ".join(f"'{x}'" for x in MARKS)}][event_id % {len(MARKS)} + 1] || ' x' AS w FROM o), m AS (SELECT job, {_messages_sql()} AS m, min(place) AS place FROM w GROUP BY ALL), k AS (SELECT job, string_agg(m, '|' ORDER BY place) AS said FROM m WHERE m IS NOT NULL GROUP BY job)
  SELECT j.job, coalesce(said, '') AS said FROM (SELECT DISTINCT job FROM ev) j LEFT JOIN k ON j.job = k.job""")
def _user_messages(s, d):
    marks = F.array(*[F.lit(x) for x in MARKS])
    warning = F.concat(F.lit("page 3: "), F.element_at(marks, (F.col("event_id") % len(MARKS) + 1).cast("int")), F.lit(" x"))
    lists = job_events(s, d).withColumn("w", warning).groupBy("job").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "w"))).alias("e"))
    return lists.select("job", F.array_join(listing.user_messages(F.col("e.w")), "|").alias("said"))

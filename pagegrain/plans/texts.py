"""Queries over texts: rules on lines, headings and sentences, corrections, keys and delays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as txt
from ..operators import alignment
from ..sources.tables import table
from .catalog import query

#: Literal lines that no table holds, in Spark and in DuckDB.
FIXTURE = [
    (1, "Title"), (2, "region_12"), (3, "Region 7"), (4, "region 12345"), (5, "Image size: 3 x 4 px"), (6, "OCR  task now"),
    (7, "please return line-level ocr with bbox"), (8, "ordinary words"), (9, ""), (10, None), (11, "能力（The Abilities）：插件/工具"),
    (12, "记忆 (The Memory) : RAG & Embedding"), (13, "Plain: text"), (14, "a(b): c"), (15, "(x) y: 12"), (16, " (AI) "), (17, "中文"),
    (18, "ab12"), (19, "2024"), (20, "{" * 40 + "}" * 30), (21, "x" + "}}]}" * 20 + "abcdefghijklmnopqrst"), (22, "longer words here"), (23, "One. Two! 三。四？ five"),
    (24, "BOLD"), (25, "700"), (26, "400"), (27, "off"), (28, "first\r\n  second \r\n\r\nthird"),
]
_ROWS = ", ".join(f"({i}, {'NULL' if t is None else chr(39) + t.replace(chr(13), '<r>').replace(chr(10), '<n>') + chr(39)})" for i, t in FIXTURE)
LINES = f"""fixture AS (SELECT id, replace(replace(t, '<r>', chr(13)), '<n>', chr(10)) AS t FROM (VALUES {_ROWS}) v(id, t)),
  lines AS (SELECT 0::BIGINT AS doc, id::BIGINT AS line_no, t FROM fixture UNION ALL SELECT doc_id + 1, i - 1, string_split(text, chr(10))[i] FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(i))"""
SQUEEZE = r"trim(regexp_replace(coalesce(t, ''), '\s+', ' ', 'g'))"


def _lines(s, d):
    """doc, line_no and t: the fixture as doc 0, and every line of every document."""
    fixed = s.createDataFrame(FIXTURE, "line_no long, t string").select(F.lit(0).cast("long").alias("doc"), "line_no", "t")
    found = table(s, d, "documents").select((F.col("doc_id") + 1).alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    return fixed.unionByName(found.select("doc", F.col("line_no").cast("long").alias("line_no"), "t"))


_LABELS = ", ".join(f"'{w}'" for w in txt.ECHO_LABELS)
_OPENINGS = " OR ".join(f"starts_with(q, '{w}')" for w in txt.ECHO_OPENINGS)


@query("q_prompt_echo", f"""WITH {LINES}, n AS (SELECT doc, line_no, lower({SQUEEZE}) AS q FROM lines)
  SELECT doc, line_no, q IN ({_LABELS}) OR regexp_full_match(q, 'region[_\\s-]?[0-9]{{1,4}}') OR {_OPENINGS} OR (contains(q, 'return line-level ocr') AND contains(q, 'bbox')) AS echo FROM n""")
def _echo(s, d):
    return _lines(s, d).select("doc", "line_no", txt.prompt_echo(F.col("t")).alias("echo"))


@query("q_gibberish", rf"""WITH {LINES}, p AS (SELECT doc, line_no, regexp_replace(coalesce(t, ''), '\s', '', 'g') AS p FROM lines),
  c AS (SELECT doc, line_no, length(p) AS n, len(regexp_extract_all(p, '[{{}}\[\],:]')) AS marks, len(regexp_extract_all(p, '[\p{{L}}\p{{N}}]')) AS letters, len(regexp_extract_all(p, '\}}\}}\]\}}')) + len(regexp_extract_all(p, '\}}\]\}}\]')) AS runs FROM p)
  SELECT doc, line_no, n >= 64 AND ((marks >= 0.88 * n AND letters <= 0.06 * n) OR (runs > 0 AND runs >= greatest(6, n // 80))) AS gibberish FROM c""")
def _gibberish(s, d):
    return _lines(s, d).select("doc", "line_no", txt.gibberish(F.col("t")).alias("gibberish"))


@query("q_short_token", rf"""WITH {LINES}, r AS (SELECT doc, line_no, regexp_replace(coalesce(t, ''), '^\s+|\s+$', '', 'g') AS r FROM lines),
  c AS (SELECT doc, line_no, r, length(regexp_replace(r, '\s', '', 'g')) AS n, len(regexp_extract_all(r, '\p{{L}}')) AS letters, len(regexp_extract_all(r, '[\x{{4E00}}-\x{{9FFF}}]')) AS cjk, len(regexp_extract_all(r, '\p{{Nd}}')) AS digits, len(regexp_extract_all(r, '[^\p{{L}}\p{{N}}\s]')) AS marks FROM r)
  SELECT doc, line_no, n > 0 AND (n <= 3 OR (n <= 12 AND regexp_matches(r, '[()/]')) OR (n <= 6 AND cjk = 0 AND ((letters >= 2 AND marks <= 2) OR digits >= 2))) AS short FROM c""")
def _short(s, d):
    return _lines(s, d).select("doc", "line_no", txt.short_token(F.col("t")).alias("short"))


@query("q_render_lines", r"""WITH """ + LINES + r""", l AS (SELECT doc, line_no, regexp_replace(coalesce(t, ''), '\r\n?', chr(10), 'g') AS t FROM lines)
  SELECT doc, line_no, array_to_string([y FOR y IN [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(t, chr(10))] IF y <> ''], chr(10)) AS shown FROM l""")
def _render(s, d):
    return _lines(s, d).select("doc", "line_no", txt.render_lines(F.col("t")).alias("shown"))


def _cut(sep: str) -> str:
    at, left, right = f"instr(l, '{sep}')", f"trim(substr(l, 1, instr(l, '{sep}')))", f"trim(substr(l, instr(l, '{sep}') + 1))"

    def brackets(x: str) -> str:
        return f"((contains({x}, '(') AND contains({x}, ')')) OR (contains({x}, '（') AND contains({x}, '）')))"

    fits = f"{at} >= 3 AND {at} < length(l) - 1 AND length(regexp_replace({right}, '\\s', '', 'g')) >= 2 AND {brackets(left)} AND ({brackets(right)} OR regexp_matches({right}, '[/&+、]') OR regexp_matches({left} || {right}, '[A-Za-z]'))"
    return f"WHEN {fits} THEN {left} || chr(10) || {right}"


@query("q_heading_lines", rf"""WITH {LINES}, l AS (SELECT doc, line_no, array_to_string([y FOR y IN [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(regexp_replace(coalesce(t, ''), '\r\n?', chr(10), 'g'), chr(10))] IF y <> ''], chr(10)) AS l FROM lines)
  SELECT doc, line_no, CASE WHEN contains(l, chr(10)) THEN l {_cut('：')} {_cut(':')} ELSE l END AS heading FROM l""")
def _heading(s, d):
    return _lines(s, d).select("doc", "line_no", txt.heading_lines(F.col("t")).alias("heading"))


@query("q_sentences", rf"""WITH {LINES}, q AS (SELECT doc, line_no, [y FOR y IN [trim(x) FOR x IN regexp_extract_all({SQUEEZE}, '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$')] IF y <> ''] AS parts FROM lines)
  SELECT doc, line_no, CAST(len(parts) AS BIGINT) AS n, parts[1] AS first FROM q""")
def _sentences(s, d):
    parts = txt.sentences(F.col("t"))
    return _lines(s, d).select("doc", "line_no", F.size(parts).cast("long").alias("n"), F.get(parts, 0).alias("first"))


@query("q_flags", rf"""WITH {LINES}, q AS (SELECT doc, line_no, lower(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS q FROM lines)
  SELECT doc, line_no, CASE WHEN q IN ('true', '1', 'yes', 'y', 'on', 'bold', 'semibold') THEN true WHEN q IN ('false', '0', 'no', 'n', 'off', 'normal', 'regular') THEN false WHEN regexp_full_match(q, '[0-9]{{1,9}}') THEN CAST(q AS INT) >= 600 END AS flag FROM q""")
def _flags(s, d):
    return _lines(s, d).select("doc", "line_no", txt.flag(F.col("t")).alias("flag"))


@query("q_join_tokens", r"""WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations)
  SELECT conv_id, turn, coalesce(regexp_matches(text, '[\p{L}\p{N}]$') AND regexp_matches(after, '^[\p{L}\p{N}]') AND NOT regexp_matches(text, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]') AND NOT regexp_matches(after, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]'), false) AS space FROM c""")
def _space(s, d):
    after = F.expr("lead(text) over (partition by conv_id order by turn)")
    turns = table(s, d, "conversations").select("conv_id", "turn", "text", after.alias("after"))
    return turns.select("conv_id", "turn", txt.needs_space(F.col("text"), F.col("after")).alias("space"))


@query("q_corrected", """WITH n AS (SELECT conv_id, turn, 1 AS seq, ' ' || upper(role) || ' ' AS new FROM conversations WHERE conv_id % 3 = 0 UNION ALL SELECT conv_id, turn, 2, CASE WHEN turn % 2 = 0 THEN ' ' ELSE 'x' || turn END FROM conversations WHERE conv_id % 5 = 0 UNION ALL SELECT conv_id, turn + 1000, 3, 'none' FROM conversations),
  l AS (SELECT conv_id, turn, arg_max(trim(new), seq) AS new FROM n WHERE trim(new) <> '' GROUP BY ALL) SELECT c.conv_id, c.turn, coalesce(l.new, c.text) AS text FROM conversations c LEFT JOIN l ON c.conv_id = l.conv_id AND c.turn = l.turn""")
def _corrected(s, d):
    turns = table(s, d, "conversations")
    upper = turns.where("conv_id % 3 = 0").selectExpr("conv_id", "turn", "1 as seq", "concat(' ', upper(role), ' ') as new")
    numbers = turns.where("conv_id % 5 = 0").selectExpr("conv_id", "turn", "2 as seq", "if(turn % 2 = 0, ' ', concat('x', turn)) as new")
    unknown = turns.selectExpr("conv_id", "turn + 1000 as turn", "3 as seq", "'none' as new")
    return alignment.corrected(turns.select("conv_id", "turn", "text"), upper.unionByName(numbers).unionByName(unknown), "conv_id", "turn").select("conv_id", "turn", "text")


@query("q_hash_key", "SELECT doc_id, left(sha1(text), 12) AS key FROM documents")
def _key(s, d):
    return table(s, d, "documents").select("doc_id", F.left(F.sha1("text"), F.lit(12)).alias("key"))


@query("q_retry_delay", "SELECT event_id, greatest(CASE WHEN event_id % 3 = 0 THEN 2.0::DOUBLE ELSE 0.25::DOUBLE END, least(8.0::DOUBLE, 0.75::DOUBLE * pow(2.0::DOUBLE, event_id % 7))) AS delay FROM events")
def _delay(s, d):
    status = F.when(F.col("event_id") % 3 == 0, 429).otherwise(500)
    return table(s, d, "events").select("event_id", txt.retry_delay(F.col("event_id") % 7, status).alias("delay"))

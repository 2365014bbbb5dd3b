"""Queries on names of settings, listings of models and styles of items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import settings, styles
from .catalog import query

#: Rows given here: no table holds settings, models or items.
VALUES = sorted({other for _, names, _ in settings.SETTINGS.values() for name, others in names.items() for other in (name, *others)})
VALUES = [*VALUES, None, "", "  ", " Auto ", "SMART", "Speed-First　", "unheard of", "baidu_doc"]


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


def _canonical_sql() -> str:
    known = [(s, other, name) for s, (_, names, allowed) in settings.SETTINGS.items() for name, others in names.items() for other in others]
    free = [f"'{s}'" for s, (_, _, allowed) in settings.SETTINGS.items() if allowed is None]
    valid = [(s, v) for s, (_, _, allowed) in settings.SETTINGS.items() for v in allowed or ()]
    return f"""WITH v AS (SELECT unnest([{', '.join(map(_quoted, VALUES))}]) AS value), d(setting, fallback) AS (VALUES {', '.join(f"('{s}', '{d}')" for s, (d, _, _) in settings.SETTINGS.items())}),
  other(setting, given, name) AS (VALUES {', '.join(str(k) for k in known)}), valid(setting, given) AS (VALUES {', '.join(str(k) for k in valid)}),
  g AS (SELECT setting, fallback, value, lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) AS given FROM d, v)
  SELECT g.setting, value, coalesce(other.name, CASE WHEN g.given = '' OR g.given IS NULL THEN fallback WHEN g.setting IN ({', '.join(free)}) OR valid.given IS NOT NULL THEN g.given ELSE fallback END) AS name
  FROM g LEFT JOIN other ON other.setting = g.setting AND other.given = g.given LEFT JOIN valid ON valid.setting = g.setting AND valid.given = g.given"""


@query("q_settings", _canonical_sql())
def _settings(s, d):
    rows = s.createDataFrame([(v,) for v in VALUES], "value string")
    named = F.array(*(F.struct(F.lit(n).alias("setting"), settings.canonical(n, F.col("value")).alias("name")) for n in settings.SETTINGS))
    return rows.select("value", F.explode(named).alias("r")).select("r.setting", "value", "r.name")


#: model, listed inputs, listed outputs, whether it sees, whether it is for texts in pictures.
MODELS = [
    ("gpt-4o-mini", None, None, True, False),
    ("openai/gpt-4o", None, None, False, False),
    ("GPT-5", [], [], True, False),
    ("gpt-4o-audio", None, None, False, False),
    ("o3", None, None, True, False),
    ("o3mini", None, None, False, False),
    ("o1-preview", None, None, True, False),
    ("Qwen/Qwen2.5-VL-72B", None, None, True, False),
    ("qwen-vlo", None, None, True, False),
    ("qwen-image", ["image"], ["image"], False, False),
    ("plain-text", ["vision"], [], True, False),
    ("plain-text", ["text"], ["text"], False, False),
    ("plain-text", ["image"], ["structured_output", "audio"], True, False),
    ("zai/glm-4.5v", None, None, True, False),
    ("glm-4.5", None, None, False, False),
    ("deepseek-ai/DeepSeek-OCR", None, None, True, True),
    ("PaddleOCR_VL", None, None, True, True),
    ("kimi-latest-vl", None, None, True, False),
    ("text-embedding-vl", None, None, False, False),
    ("doubao-1.5-vision-pro", None, None, True, False),
    ("mineru2", None, None, True, True),
    (None, None, None, False, False),
]


@query("q_capabilities", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {sees}, {reads}, true)" for i, (_, _, _, sees, reads) in enumerate(MODELS)) + ") v(row, sees, reads, others)")
def _capabilities(s, d):
    rows = s.createDataFrame([(i, *m[:3]) for i, m in enumerate(MODELS)], "row int, model string, inputs array<string>, outputs array<string>")
    return rows.select("row", *(settings.has_capability(F.col("model"), F.col("inputs"), F.col("outputs"), F.lit(c)).alias(n) for c, n in (("vision", "sees"), ("ocr", "reads"), ("all", "others"))))


#: item, colour, size, font, bold, italic.
STYLES = [
    ('{"color": "#ABCDEF", "font_size": "12.5 pt", "font": " Arial  Bold ", "bold": true, "italic": 0}', "#abcdef", 12.5, "Arial Bold", True, False),
    ('{"color": null, "style": {"color": "#abc", "size": 9, "weight": "700"}}', None, 9.0, None, True, None),
    ('{"style": {"color": "#abc", "slant": "off", "font_weight": 400}}', "#aabbcc", None, None, None, False),
    ('{"text_color": [300, -4, 16.9], "size": 241, "font_weight": "normal"}', "#ff0010", None, None, False, None),
    ('{"fg_color": "0xFF102030", "text_size": "x", "weight": "500"}', "#102030", None, None, False, None),
    ('{"color": "red", "font_size_pt": 0, "font_size": 12, "is_bold": "maybe", "bold": "maybe"}', None, None, None, None, None),
    ('{"color": ["1", true, 2], "size": true, "family": "", "is_italic": "Yes"}', "#010102", None, None, None, True),
    ('{"color": [1, 2], "font_size_pt": "1e2", "bold": 1.0, "italic": 2}', None, 100.0, None, True, None),
    ("not json", None, None, None, None, None),
    (None, None, None, None, None, None),
]


def _literal(value: object) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value).lower()


@query("q_styles", "SELECT row, colour, size::DOUBLE AS size, font, bold, italic FROM (VALUES " + ", ".join(f"({i}, {', '.join(map(_literal, r[1:]))})" for i, r in enumerate(STYLES)) + ") v(row, colour, size, font, bold, italic)")
def _styles(s, d):
    rows = s.createDataFrame([(i, r[0]) for i, r in enumerate(STYLES)], "row int, item string")
    return rows.select("row", styles.text_style(F.col("item")).alias("t")).select("row", "t.*")

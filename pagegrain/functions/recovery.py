"""Records out of damaged JSON, in Arrow batches: no built-in function reads on after an error."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from itertools import chain, islice
from typing import Any

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

#: Keys by which a record is told, and keys that hold records, in order.
BOX_KEYS = {"bbox", "box", "bounding_box", "location", "rect", "points", "polygon", "position", "coordinates", "quad", "b", "bbox_2d"}
TEXT_KEYS = {"text", "words", "content", "transcription", "value", "label", "t"}
HOLDERS = ("items", "result", "results", "data", "lines", "blocks", "text_blocks", "ocr", "output")
#: How deep holders are searched, how many opening brackets are tried, and how many records a text gives.
DEEPEST, STARTS, MOST = 4, 16, 1000

_DECODER = json.JSONDecoder()
_BETWEEN = re.compile(r"[ \t\r\n,]*")
#: A whole string, closed or not, or a brace.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*["\\]?|[{}]', re.DOTALL)


def records(value: Any, depth: int = 0) -> list[dict]:
    """The objects of a list, an object that has a box and a text, or those of the first child that has some, holders first."""
    if isinstance(value, list):
        return [v for v in value if isinstance(v, dict)] if depth <= DEEPEST else []
    if not isinstance(value, dict) or depth > DEEPEST:
        return []
    if not BOX_KEYS.isdisjoint(value) and not TEXT_KEYS.isdisjoint(value):
        return [value]
    children = chain((value[k] for k in HOLDERS if k in value), value.values())
    return next(filter(None, (records(child, depth + 1) for child in children)), [])


def _of(value: Any) -> list[dict]:
    return records(value) or ([value] if isinstance(value, dict) else [])


def _decoded(text: str, at: int) -> tuple[Any, int] | None:
    try:
        return _DECODER.raw_decode(text, at)
    except (ValueError, RecursionError):
        return None


def _array_items(text: str, at: int) -> Iterator[dict]:
    """What can be read from behind an opening bracket up to its end or the first error."""
    while True:
        at = _BETWEEN.match(text, at).end()
        found = None if text.startswith("]", at) else _decoded(text, at)
        if found is None:
            return
        yield from _of(found[0])
        at = found[1]


def from_array(text: str, most: int = MOST) -> list[dict]:
    """The most records that one of the first brackets gives; of equals the first."""
    starts = islice(re.finditer(r"\[", text), STARTS)
    return max((list(islice(_array_items(text, s.end()), most)) for s in starts), key=len, default=[])


def _objects(text: str) -> Iterator[dict]:
    at = text.find("{")
    while at >= 0:
        found = _decoded(text, at)
        if found is not None:
            yield from _of(found[0])
        at = text.find("{", found[1] if found else at + 1)


def _relaxed(text: str) -> Any:
    """JSON, or a Python literal."""
    for read in (json.loads, ast.literal_eval):
        try:
            return read(text)
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            continue
    return None


def _balanced(text: str) -> Iterator[dict]:
    """Outermost braces that close, those within double quotes left out."""
    depth = start = 0
    for token in _TOKEN.finditer(text):
        if token[0] == "{":
            start = token.start() if depth == 0 else start
            depth += 1
        elif token[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                yield from _of(_relaxed(text[start : token.end()]))


def from_parts(text: str, most: int = MOST) -> list[dict]:
    """Records of an array, else of single objects, else of balanced braces."""
    return from_array(text, most) or list(islice(_objects(text), most)) or list(islice(_balanced(text), most))


def _unfenced(text: str) -> str:
    """What stands between the fences of a text that starts with one, else nothing."""
    lines = text.strip().splitlines()
    if not lines or not lines[0].startswith("```"):
        return ""
    end = len(lines) - 1 if len(lines) > 1 and lines[-1].strip().startswith("```") else len(lines)
    return "\n".join(lines[1:end]).strip()


def _whole(text: str) -> list[dict]:
    try:
        return records(json.loads(text))
    except (ValueError, RecursionError):
        return []


def from_text(text: str) -> list[dict]:
    """Records of a text, whole, within its outermost brackets or in parts; then of what its fences hold."""
    for candidate in filter(None, (text, _unfenced(text))):
        first, last = candidate.find("["), candidate.rfind("]")
        found = _whole(candidate) or (_whole(candidate[first : last + 1]) if 0 <= first < last else []) or from_parts(candidate)
        if found:
            return found
    return []


@pandas_udf(ArrayType(StringType()))
def recovered(texts: pd.Series) -> pd.Series:
    """Each record of a text as JSON; null where none is found."""

    def of(text: str | None) -> list[str] | None:
        found = from_text(text) if text else []
        return [json.dumps(r, ensure_ascii=False, skipkeys=True, default=str) for r in found] or None

    return texts.map(of)

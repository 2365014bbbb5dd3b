"""Widths of texts without a font, lines of a width, and whether a split or a probe of them is worth it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import CJK, WHITE, compact_length, render_lines, spaced

#: Widths of characters in shares of the font size, by class; any other is OTHER wide.
WIDTHS = ((f"[{WHITE}]", 0.33), (CJK, 1.0), ("[0-9]", 0.58), ("[A-Z]", 0.70), ("[a-z]", 0.56))
OTHER = 0.38
#: Signs that begin no line, and that end none.
NOT_FIRST = ",.;:!?)]}、，。！？：；）】」』》〉%‰°"
NOT_LAST = "([{（《【「『“‘"
#: Times that signs are moved over line ends at most.
MOVES = 3


def text_width(text: Column, size: Column) -> Column:
    """Points that a text takes at a font size of 1 at least; null is 0."""
    given = F.coalesce(text, F.lit(""))
    counts = [(F.regexp_count(given, F.lit(pattern)), share) for pattern, share in WIDTHS]
    others = F.length(given)
    total = F.lit(0.0)
    for count, share in counts:
        others, total = others - count, total + count * share
    return (total + others * OTHER) * F.greatest(F.lit(1.0), size)


def _native(pattern: str) -> re.Pattern:
    """A class of characters in Python's notation."""
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda code: chr(int(code[1], 16)), pattern))


_CLASSES = [(_native(pattern), share) for pattern, share in WIDTHS]


@lru_cache(100_000)
def _share(ch: str) -> float:
    return next((share for pattern, share in _CLASSES if pattern.fullmatch(ch)), OTHER)


def _wide(text: str, size: float) -> float:
    return sum(map(_share, text)) * size


def _pieces(tokens: list[str], width: float, size: float) -> Iterator[tuple[str, float]]:
    """Tokens, those wider than a line by their characters."""
    for token in tokens:
        wide = _wide(token, size)
        if wide <= width:
            yield token, wide
        else:
            yield from ((ch, _wide(ch, size)) for ch in token)


def _filled(pieces: Iterator[tuple[str, float]], width: float) -> list[str]:
    lines, line, used = [], "", 0.0
    for piece, wide in pieces:
        if line and used + wide <= width:
            line, used = line + piece, used + wide
            continue
        if line:
            lines.append(line.rstrip())
        line, used = ("", 0.0) if piece == " " else (piece, wide)
    return [*lines, line.rstrip()] if line else lines


def _moved(before: str, after: str) -> tuple[str, str]:
    """Signs that may not begin a line go to the line before, those that may not end one to the line after."""
    while before and after and after[0] in NOT_FIRST:
        before, after = before + after[0], after[1:].lstrip()
    while before and after and before[-1] in NOT_LAST:
        before, after = before[:-1].rstrip(), before[-1] + after
    return before, after


def wrap(tokens: list[str], width: float, size: float) -> list[str]:
    """Lines of a paragraph's tokens, each as full as its width allows."""
    width, size = max(1.0, width), max(1.0, size)
    lines = _filled(_pieces(tokens, width, size), width)
    for _ in range(MOVES):
        before = list(lines)
        for i in range(1, len(lines)):
            lines[i - 1], lines[i] = _moved(lines[i - 1], lines[i])
        if lines == before:
            break
    return [line.strip() for line in lines if line.strip()] or ["".join(tokens)]


@F.pandas_udf(ArrayType(StringType()))
def wrapped(tokens: pd.Series, width: pd.Series, size: pd.Series) -> pd.Series:
    """Lines of each row's tokens; a row without tokens has none."""
    return pd.Series([wrap(list(t), float(w), float(s)) if t is not None and len(t) else [] for t, w, s in zip(tokens, width, size)], dtype=object)


def plausible_split(text: Column, lines: Column, width: Column, height: Column, page_width: float) -> Column:
    """Whether two lines or more hold about a text's characters; not so for a wide flat box with a very short line."""

    def packed(value: Column) -> Column:
        return F.regexp_replace(value, spaced(r"\s+"), "")

    given, joined = packed(F.coalesce(text, F.lit(""))), packed(F.array_join(lines, ""))
    n, m = F.length(given), F.length(joined)
    cut = (F.contains(joined, given) | F.contains(given, joined)) & (n <= 44) & (F.abs(n - m) >= 3)
    least: Column = F.when(n <= 36, 0.62).when(n <= 64, 0.56).otherwise(0.45)
    alike = F.least(n, m) / F.greatest(F.lit(1), n, m) >= least
    lengths = F.transform(lines, lambda x: F.length(packed(x)))
    low, high = F.array_min(lengths), F.array_max(lengths)
    wide, flat = F.greatest(F.lit(1.0), width), F.greatest(F.lit(1.0), height)
    banner = (wide >= 0.25 * page_width) & (flat / wide <= 0.12)
    uneven = (F.size(lines) == 2) & (low > 0) & (low <= 5) & (low < 0.30 * high) & banner
    return (F.size(lines) > 1) & (m > 0) & ((n == 0) | (~cut & alike & ~uneven))


def probe_worth(text: Column, width: Column, height: Column, line: Column, heading: Column, wraps: Column, split: Column) -> Column:
    """Whether counting a one-line text's lines on the picture may tell more than its box does; ``split`` texts never."""
    shown = render_lines(text)
    n = compact_length(shown)
    ratio = F.greatest(F.lit(1.0), height) / F.greatest(F.lit(4.0), line)
    single = ~wraps & (n <= 28) & (ratio <= 1.14)
    paragraph = wraps & ((ratio >= 1.55) | ((n >= 48) & (ratio >= 1.35)))
    worth = F.when(heading, (n >= 12) & (F.greatest(F.lit(1.0), width) >= 120)).otherwise(~single & ~paragraph)
    return ~split & ~F.contains(shown, F.lit("\n")) & (n > 10) & worth

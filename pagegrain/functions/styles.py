"""Text styles from an item's JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shapes import once
from .text import cleaned

#: The keys that may hold each part of a style, in order.
COLOUR_KEYS = ("color", "text_color", "font_color", "fg_color")
SIZE_KEYS = ("font_size_pt", "font_size", "size", "text_size")
FONT_KEYS = ("font_name", "font", "font_family", "family")
BOLD_KEYS = ("bold", "is_bold", "font_bold", "font_weight", "weight")
ITALIC_KEYS = ("italic", "is_italic", "font_italic", "slant")
#: Words that mean yes and no.
YES = ("true", "1", "yes", "y", "on", "bold", "semibold")
NO = ("false", "0", "no", "n", "off", "normal", "regular")
#: Points that a size may have.
SMALLEST, LARGEST = 1.0, 240.0


def _present(item: Column, keys: tuple[str, ...]) -> Column:
    """The value of the first key that is there, null values included, in the item and then in its ``style``."""
    return F.coalesce(*(F.try_variant_get(item, f"$.{at}{key}", "variant") for at in ("", "style.") for key in keys))


def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).rlike(f"^(?:{kind})")


def _string(value: Column) -> Column:
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def _number(value: Column) -> Column:
    return F.when(_is(value, "BIGINT|DECIMAL|DOUBLE|FLOAT"), F.try_variant_get(value, "$", "double"))


def _channel(value: Column, i: int) -> Column:
    """Two hexadecimal digits of a colour's part: a number, a flag or a string of digits."""
    part = F.try_variant_get(value, f"$[{i}]", "variant")
    digits = F.regexp_extract(_string(part), r"^\s*([+-]?\d+)\s*$", 1).try_cast("double")
    flag = F.when(_is(part, "BOOLEAN"), F.try_variant_get(part, "$", "boolean").cast("double"))
    whole = F.coalesce(_number(part), flag, digits)
    return F.when(whole.isNotNull(), F.lpad(F.lower(F.hex(F.least(F.lit(255.0), F.greatest(F.lit(0.0), whole)).cast("long"))), 2, "0"))


def colour(value: Column) -> Column:
    """``#rrggbb`` of a list of three parts or of 3, 6 or 8 digits, of which the last 6 count."""
    parts = F.when(_is(value, "ARRAY"), F.concat(F.lit("#"), *(_channel(value, i) for i in range(3))))
    digits = F.regexp_replace(cleaned(_string(value)), "^(?:#|0[xX])", "")
    short = F.length(digits) == 3
    six = F.when(F.length(digits) == 8, F.right(digits, F.lit(6))).when(short, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    named = F.when((F.length(six) == 6) & six.rlike(r"(?i)^ ?[+-]?(?:0x_?)?[0-9a-f]+(?:_[0-9a-f]+)* ?$"), F.concat(F.lit("#"), F.lower(six)))
    return F.coalesce(parts, named)


def points(value: Column) -> Column:
    """A size from 1 to 240 points, of a number or of digits with or without ``pt``."""
    digits = F.trim(F.replace(F.lower(F.trim(_string(value))), F.lit("pt"), F.lit("")))
    read = F.when(digits.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$"), digits.try_cast("double"))
    size = F.coalesce(_number(value), read)
    return F.when(size.between(SMALLEST, LARGEST), size)


def optional_flag(value: Column) -> Column:
    """Yes or no of a flag, 0 and 1, a word, or a weight, which is bold from 600 on; else null."""
    word = F.lower(F.trim(_string(value)))
    number = _number(value)
    return (
        F.when(_is(value, "BOOLEAN"), F.try_variant_get(value, "$", "boolean"))
        .when((number == 1) | word.isin(*YES), True)
        .when((number == 0) | word.isin(*NO), False)
        .when(word.rlike(r"^\d+$"), word.try_cast("double") >= 600)
    )


def text_style(item: Column) -> Column:
    """colour, size, font, bold and italic of an item in JSON; the first key that is there decides, even if its value is of no use."""
    parts = (("colour", COLOUR_KEYS, colour), ("size", SIZE_KEYS, points), ("font", FONT_KEYS, lambda v: cleaned(_string(v))), ("bold", BOLD_KEYS, optional_flag), ("italic", ITALIC_KEYS, optional_flag))
    return once(F.try_parse_json(item), lambda parsed: F.struct(*(once(_present(parsed, keys), read).alias(name) for name, keys, read in parts)))

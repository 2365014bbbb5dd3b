"""Predicates on kinds, labels and errors that payloads give as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

#: Words that make the kind of a content item an image, and more for parsed items.
CONTENT_IMAGES = ("image", "img", "figure", "picture", "photo", "chart", "graphic", "illustration")
PARSER_IMAGES = (*CONTENT_IMAGES, "screenshot", "logo", "seal")
#: Words of a layout label that make it an image, and those that overrule them.
LABEL_IMAGES = ("image", "figure", "chart", "diagram", "illustration", "graphic", "picture", "photo", "screenshot", "logo", "icon", "seal")
LABEL_OTHERS = ("text", "table", "formula", "caption", "title", "paragraph", "list", "header", "footer")
#: Words of a formula span, whole types of an image span.
FORMULA_SPANS = ("equation", "formula", "latex", "math")
IMAGE_SPANS = ("image", "img", "figure", "picture", "photo")
#: Answers after which a request is sent again, by status and by message, and those of an unknown model.
RETRY_STATUS = (408, 409, 425, 429, 500, 502, 503, 504)
RETRY_WORDS = (
    "timed out",
    "timeout",
    "rate limit",
    "too many requests",
    "temporarily unavailable",
    "connection reset",
    "connection aborted",
    "connection refused",
    "remote protocol error",
    "server disconnected",
    "service unavailable",
    "gateway",
    "try again",
    "overloaded",
)
UNSUPPORTED_WORDS = ("invalid model", "model not found", "unsupported model", "does not support", "not support", "unknown model", "model not exist", "404")


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text, in any case, holds one of the words; null holds none."""
    return F.regexp_like(F.lower(F.coalesce(text, F.lit(""))), F.lit("|".join(words)))


def layout_label(text: Column) -> Column:
    """Lower case with _ for each blank, - and /; null and blank are empty."""
    return F.translate(F.lower(F.coalesce(clean(text), F.lit(""))), "- /", "___")


def image_label(text: Column) -> Column:
    return ~holds(layout_label(text), LABEL_OTHERS) & holds(layout_label(text), LABEL_IMAGES)


def image_span(text: Column) -> Column:
    return F.coalesce(F.lower(clean(text)).isin(*IMAGE_SPANS), F.lit(False))


def skipped_block(text: Column) -> Column:
    """Whether a block's label is a footer or a page number, which are not recognised."""
    return F.regexp_like(layout_label(text), F.lit("(^|_)footer$|^page_number"))


def retryable(status: Column, message: Column) -> Column:
    return F.coalesce(status.isin(*RETRY_STATUS), F.lit(False)) | holds(message, RETRY_WORDS)


def exports_pages(enabled: Column, pages: Column, most: Column) -> Column:
    """Whether page files are kept: switched on and, if there is a limit above 0, within it."""
    limit = F.coalesce(most, F.lit(0))
    return F.coalesce(enabled, F.lit(False)) & ~((limit > 0) & (F.coalesce(pages, F.lit(0)) > limit))


def footer_mark(text: Column, b: Column, width: float, height: float, brand: str, extra: int = 24) -> Column:
    """Whether a text that is little more than a brand's name stands small in the page's lower right corner.

    Only letters and digits of the text count, in lower case. Null texts, null boxes and
    boxes without an area are none.
    """
    packed = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")
    named = packed.contains(brand) & (F.length(F.replace(packed, F.lit(brand), F.lit(""))) <= extra)
    sized = (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]) & ((b["x1"] - b["x0"]) / width <= 0.22) & ((b["y1"] - b["y0"]) / height <= 0.08)
    placed = ((b["y0"] + b["y1"]) / 2.0 >= 0.84 * height) & ((b["x0"] + b["x1"]) / 2.0 >= 0.72 * width)
    return F.coalesce(named & sized & placed, F.lit(False))

"""Boxes and polygons in the many forms that payloads give them, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The key sets under which a payload's object is a box by its corners.
CORNER_KEYS = (("x0", "y0", "x1", "y1"), ("xmin", "ymin", "xmax", "ymax"))
SIZE_KEYS = ("left", "top", "width", "height")


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)))


def _whole(values: Column) -> Column:
    return F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def _around(xs: Column, ys: Column) -> Column:
    """The envelope of points; null without points or with a coordinate that is no number."""
    return F.when((F.size(xs) > 0) & _whole(xs) & _whole(ys), box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often the expression refers to it."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def _every_second(values: Column, first: int) -> Column:
    return F.filter(values, lambda v, i: i % 2 == first)


def parse_box(text: Column) -> Column:
    """A box from JSON text: four numbers, an object by corners or by place and size,
    a list of point objects, a list of pairs, or eight and more numbers in turn.

    Corners of four numbers are put in order, those of objects are not. All else is null.
    """

    def read(value: Column) -> Column:
        """All readings of a value; those that do not fit it are null."""
        kinds = {"flat": "array<double>", "objects": "array<struct<x:double,y:double,left:double,top:double>>", "nested": "array<array<double>>"}
        keys = dict.fromkeys((*SIZE_KEYS, *CORNER_KEYS[0], *CORNER_KEYS[1]))
        return F.struct(*(F.try_variant_get(value, "$", k).alias(n) for n, k in kinds.items()), *(F.try_variant_get(value, f"$.{k}", "double").alias(k) for k in keys))

    def choose(r: Column) -> Column:
        def keyed(names: tuple[str, ...], corners: Callable[..., Column]) -> Column:
            sides = [r[n] for n in names]
            return F.when(_whole(F.array(*sides)), corners(*sides))

        flat, objects, nested = r["flat"], r["objects"], r["nested"]
        four = box(F.least(flat[0], flat[2]), F.least(flat[1], flat[3]), F.greatest(flat[0], flat[2]), F.greatest(flat[1], flat[3]))
        as_list = F.coalesce(
            F.when((F.size(flat) == 4) & _whole(flat), four),
            _around(F.transform(objects, lambda p: F.coalesce(p["x"], p["left"])), F.transform(objects, lambda p: F.coalesce(p["y"], p["top"]))),
            F.when(F.forall(nested, lambda p: F.size(p) >= 2), _around(F.transform(nested, lambda p: F.get(p, F.lit(0))), F.transform(nested, lambda p: F.get(p, F.lit(1))))),
            F.when((F.size(flat) >= 8) & (F.size(flat) % 2 == 0), _around(_every_second(flat, 0), _every_second(flat, 1))),
        )
        as_object = F.coalesce(keyed(SIZE_KEYS, lambda x, y, w, h: box(x, y, x + w, y + h)), *(keyed(k, box) for k in CORNER_KEYS))
        return F.when(F.ltrim(text).startswith("["), as_list).when(F.ltrim(text).startswith("{"), as_object)

    return once(once(F.try_parse_json(text), read), choose)


#: Keys below which a vendor's item may have its box, in order of trial.
VENDOR_KEYS = ("bbox", "box", "rect", "rectangle", "polygon", "poly", "points", "location", "coordinates", "coordinate")


def _points(text: Column) -> Column:
    """A number, or a text that is one, with or without the unit pt."""
    return F.trim(F.replace(F.lower(F.trim(text)), F.lit("pt"), F.lit(""))).try_cast("double")


def _present(values: Column) -> Column:
    return (F.size(values) > 0) & F.forall(values, lambda v: v.isNotNull())


def _number(value: Column, *keys: str) -> Column:
    """The first key's number that is not 0, else the last key's."""
    found = [_points(F.try_variant_get(value, f"$.{k}", "string")) for k in keys]
    return F.coalesce(*(F.nullif(v, F.lit(0.0)) for v in found), found[-1])


def _vendor_list(value: Column) -> Column:
    """Four numbers (place and size if the latter two are not beyond the former), 8 or more in turn, pairs or points."""
    flat = F.transform(F.try_variant_get(value, "$", "array<string>"), _points)
    nested = F.try_variant_get(value, "$", "array<array<string>>")
    objects = F.try_variant_get(value, "$", "array<variant>")
    sized = (flat[2] <= flat[0]) | (flat[3] <= flat[1])
    four = F.when(sized, box(flat[0], flat[1], flat[0] + flat[2], flat[1] + flat[3])).otherwise(box(flat[0], flat[1], flat[2], flat[3]))
    pairs = F.transform(nested, lambda p: _points(F.get(p, F.lit(0)))), F.transform(nested, lambda p: _points(F.get(p, F.lit(1))))
    points = F.transform(objects, lambda p: _number(p, "x", "left")), F.transform(objects, lambda p: _number(p, "y", "top"))
    return F.coalesce(
        F.when((F.size(flat) == 4) & _present(flat), four),
        F.when((F.size(flat) >= 8) & _present(flat), _around(_every_second(flat, 0), _every_second(flat, 1))),
        *(F.when(_present(xs) & _present(ys), _around(xs, ys)) for xs, ys in (pairs, points)),
    )


def _vendor_position(value: Column) -> Column:
    """Place and size if the size is above 0, else read as any list."""
    flat = F.transform(F.try_variant_get(value, "$", "array<string>"), _points)
    x, y, w, h = (_number(value, *k) for k in (("left", "x"), ("top", "y"), ("width", "w"), ("height", "h")))
    as_object = F.when(x.isNotNull() & y.isNotNull() & (w > 0) & (h > 0), box(x, y, x + w, y + h))
    as_list = F.when((F.size(flat) == 4) & _present(flat) & (flat[2] > 0) & (flat[3] > 0), box(flat[0], flat[1], flat[0] + flat[2], flat[1] + flat[3]))
    outline = F.coalesce(F.try_variant_get(value, "$.polygon", "variant"), F.try_variant_get(value, "$.points", "variant"))
    return F.coalesce(as_list, as_object, _vendor_list(value), _vendor_list(outline))


def vendor_box(text: Column) -> Column:
    """A box from a vendor's item as JSON text, or null.

    A list is read by its form. Of an object its ``position`` counts first, as place and
    size, then the lists below VENDOR_KEYS in turn, then its own sides. Numbers may be
    texts with the unit pt. A side of 0 counts only below the last of its key's names,
    so an item with ``left`` 0 and no other name for it has no box.
    """

    def read(value: Column) -> Column:
        below = F.array(*(F.try_variant_get(value, f"$.{k}", "variant") for k in VENDOR_KEYS))
        found = F.filter(F.transform(below, _vendor_list), lambda b: b.isNotNull())
        x, y = _number(value, "left", "x0", "x"), _number(value, "top", "y0", "y")
        right, bottom = _number(value, "right", "x1"), _number(value, "bottom", "y1")
        w, h = _number(value, "width", "w"), _number(value, "height", "h")
        placed = x.isNotNull() & y.isNotNull()
        sides = F.when(placed & right.isNotNull() & bottom.isNotNull(), box(x, y, right, bottom)).when(placed & w.isNotNull() & h.isNotNull(), box(x, y, x + w, y + h))
        as_object = F.coalesce(_vendor_position(F.try_variant_get(value, "$.position", "variant")), F.get(found, F.lit(0)), sides)
        return F.when(F.ltrim(text).startswith("["), _vendor_list(value)).when(F.ltrim(text).startswith("{"), as_object)

    return once(F.try_parse_json(text), read)


def content_box(text: Column) -> Column:
    """A box from a content item as JSON text: four numbers below ``bbox`` as they stand, null if one is none,
    else the envelope of 8 or more numbers below ``poly``."""

    def read(value: Column) -> Column:
        four, outline = (F.transform(F.try_variant_get(value, k, "array<string>"), lambda v: v.try_cast("double")) for k in ("$.bbox", "$.poly"))
        around = F.when((F.size(outline) >= 8) & _present(outline), _around(_every_second(outline, 0), _every_second(outline, 1)))
        return F.when(F.size(four) == 4, F.when(_present(four), box(four[0], four[1], four[2], four[3]))).otherwise(around)

    return once(F.try_parse_json(text), read)


def page_size(text: Column) -> Column:
    """Width and height above 0 of a page from its entry as JSON text: ``page_size``, the sides at the top, or those below ``meta``; else null."""

    def read(value: Column) -> Column:
        pair = F.transform(F.try_variant_get(value, "$.page_size", "array<string>"), _points)
        meta = F.try_variant_get(value, "$.meta", "variant")
        found = (
            (F.get(pair, F.lit(0)), F.get(pair, F.lit(1))),
            (_number(value, "page_width", "page_w"), _number(value, "page_height", "page_h")),
            (_number(meta, "page_width", "page_w", "width"), _number(meta, "page_height", "page_h", "height")),
        )
        return F.coalesce(*(F.when((w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height"))) for w, h in found))

    return once(F.try_parse_json(text), read)


def crop_rect(b: Column, crop: Column, dpi: int, pad_x: float = 0.0, pad_y: float = 0.0) -> Column:
    """A box in points, padded and rounded to pixels (halves to even), within a crop (x0, y0, width, height in pixels of the page); null outside of it."""

    def pixel(points: Column, origin: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(high, F.bround(points * float(dpi) / 72.0).cast("long") - origin)).cast("long")

    x0, y0 = pixel(b["x0"] - pad_x, crop["x0"], crop["width"] - 1), pixel(b["y0"] - pad_y, crop["y0"], crop["height"] - 1)
    x1, y1 = pixel(b["x1"] + pad_x, crop["x0"], crop["width"]), pixel(b["y1"] + pad_y, crop["y0"], crop["height"])
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def item_confidence(text: Column, default: float = 0.7) -> Column:
    """0 to 1 from a recognised item as JSON text: the first of four keys that is not null, percents as shares."""

    def read(value: Column) -> Column:
        raw = F.coalesce(*(F.try_variant_get(value, f"$.{k}", "string") for k in ("confidence", "c", "score", "prob")))
        share = F.coalesce(raw.try_cast("double"), F.lit(default))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((share > 1.0) & (share <= 100.0), share / 100.0).otherwise(share)))

    return once(F.try_parse_json(text), read)


def _clip(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    def into(v: Column, high: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(high.cast("double"), v))

    sides = into(left, width), into(top, height), into(right, width), into(bottom, height)
    return F.when((sides[2] > sides[0]) & (sides[3] > sides[1]), box(*sides))


def _ordered(b: Column) -> tuple[Column, Column, Column, Column]:
    return F.least(b["x0"], b["x1"]), F.least(b["y0"], b["y1"]), F.greatest(b["x0"], b["x1"]), F.greatest(b["y0"], b["y1"])


def grid_to_page(b: Column, width: Column, height: Column, grid: float = 1000.0, top: float = 1100.0) -> Column:
    """Coordinates up to ``top`` stand on a grid of ``grid``, others in points already; clipped, null if empty."""
    on_grid = F.greatest(*(F.abs(b[n]) for n in ("x0", "y0", "x1", "y1"))) <= top
    sides = [F.when(on_grid, v / grid * size).otherwise(v) for v, size in zip(_ordered(b), (width, height, width, height), strict=True)]
    return _clip(*sides, width, height)


def fit_to_page(b: Column, payload_width: Column, payload_height: Column, width: Column, height: Column) -> Column:
    """Points of a page from coordinates of unknown scale.

    In this order: fractions up to 1.2; the payload's page, if its size is known (on a
    grid of up to 1100, or when the box lies in it by 5%); the page's own points; a grid
    of 1000; else shrunk until it fits. Null without a page size or when empty.
    """
    left, top, right, bottom = _ordered(b)
    most = F.greatest(*(F.abs(v) for v in (left, top, right, bottom)))
    sized = F.coalesce((payload_width > 0) & (payload_height > 0), F.lit(False))
    grid = (payload_width <= 1100) & (payload_height <= 1100) & (most <= 1100)
    inside = (right <= payload_width * 1.05) & (bottom <= payload_height * 1.05)
    shrink = F.least(width / F.greatest(F.lit(1.0), right), height / F.greatest(F.lit(1.0), bottom))

    def scaled(v: Column, payload: Column, size: Column) -> Column:
        by_payload = F.when(grid | inside, v / payload * size).otherwise(v)
        own = F.when((right <= width * 1.05) & (bottom <= height * 1.05), v).when(most <= 1100, v / 1000.0 * size).otherwise(v * shrink)
        return F.when(most <= 1.2, v * size).when(sized, by_payload).otherwise(own)

    fitted = _clip(scaled(left, payload_width, width), scaled(top, payload_height, height), scaled(right, payload_width, width), scaled(bottom, payload_height, height), width, height)
    return F.when((width > 0) & (height > 0) & (right > left) & (bottom > top), fitted)


def corners(b: Column) -> Column:
    """The four corners of a box as points, clockwise from the top left."""
    return F.array(*(F.struct(b[x].cast("double").alias("x"), b[y].cast("double").alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))


def scale_points(points: Column, by_x: float, by_y: float) -> Column:
    """Null with fewer than three points or a point without a coordinate."""
    usable = (F.size(points) >= 3) & F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.when(usable, F.transform(points, lambda p: F.struct((p["x"] * by_x).alias("x"), (p["y"] * by_y).alias("y"))))


def points_fit(points: Column, b: Column, tolerance: float = 1.5) -> Column:
    """Whether every point lies in the box or no farther than the tolerance from it."""
    return F.forall(points, lambda p: p["x"].between(b["x0"] - tolerance, b["x1"] + tolerance) & p["y"].between(b["y0"] - tolerance, b["y1"] + tolerance))


def signature(points: Column) -> Column:
    """Tenths of each point, halves to even, as one text; points that agree in it count as equal."""
    def tenth(v: Column) -> Column:
        return F.bround(v * 10.0).cast("long").cast("string")

    return F.array_join(F.transform(points, lambda p: F.concat(tenth(p["x"]), F.lit(","), tenth(p["y"]))), ";")


def erase_padding(height: Column, fill: bool = False) -> tuple[Column, Column]:
    """Padding of an erased line in x and y, from its height in points."""
    h = F.greatest(F.lit(1.0), height.cast("double"))
    #: Factor and limits in x and in y, when filling and when blending.
    rules = ((0.30, 1.3, 6.6), (0.23, 1.0, 4.4)) if fill else ((0.35, 1.0, 8.0), (0.20, 0.8, 4.0))
    return tuple(F.greatest(F.lit(low), F.least(F.lit(high), h * share)) for share, low, high in rules)


def centred(x0: Column, x1: Column, width: float) -> Column:
    """Whether a heading stands in the middle of its page, by centre and by margins."""
    near, even = max(20.0, min(54.0, 0.055 * width)), max(24.0, min(72.0, 0.07 * width))
    a, b = (F.greatest(F.lit(0.0), F.least(v.cast("double"), F.lit(width))) for v in (x0, x1))
    return (b > a) & (F.abs((a + b) * 0.5 - 0.5 * width) <= near) & (F.abs(a - (F.lit(width) - b)) <= even)

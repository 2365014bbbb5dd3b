"""Box arithmetic as column expressions. A box is four columns x0, y0, x1, y1 behind a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMU_PER_POINT = 12_700


def side(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}.{name}") if prefix else F.col(name)


def area(box: str = "") -> Column:
    return (side(box, "x1") - side(box, "x0")) * (side(box, "y1") - side(box, "y0"))


def overlap(a: str, b: str) -> Column:
    """Area of the intersection; boxes that only touch share none."""
    w = F.least(side(a, "x1"), side(b, "x1")) - F.greatest(side(a, "x0"), side(b, "x0"))
    h = F.least(side(a, "y1"), side(b, "y1")) - F.greatest(side(a, "y0"), side(b, "y0"))
    return F.when((w > 0) & (h > 0), w * h).otherwise(0)


def meets(a: str, b: str) -> Column:
    return (side(a, "x0") < side(b, "x1")) & (side(b, "x0") < side(a, "x1")) & (side(a, "y0") < side(b, "y1")) & (side(b, "y0") < side(a, "y1"))


def iou(a: str, b: str) -> Column:
    """Intersection over union, areas at least 1."""
    both = overlap(a, b)
    return both / F.greatest(F.lit(1), F.greatest(F.lit(1), area(a)) + F.greatest(F.lit(1), area(b)) - both)


def cover(a: str, b: str) -> Column:
    """Intersection over the smaller area, areas at least 1."""
    return overlap(a, b) / F.least(F.greatest(F.lit(1), area(a)), F.greatest(F.lit(1), area(b)))


def centre_in(a: str, b: str) -> Column:
    """Whether the centre of a lies in b, edges included."""
    x, y = side(a, "x0") + side(a, "x1"), side(a, "y0") + side(a, "y1")
    return x.between(2 * side(b, "x0"), 2 * side(b, "x1")) & y.between(2 * side(b, "y0"), 2 * side(b, "y1"))


def coerce(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box with ordered corners; null when a side is null or not finite."""
    sides = [c.cast("double") for c in (x0, y0, x1, y1)]
    finite = F.lit(True)
    for c in sides:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    box = F.struct(F.least(sides[0], sides[2]).alias("x0"), F.least(sides[1], sides[3]).alias("y0"), F.greatest(sides[0], sides[2]).alias("x1"), F.greatest(sides[1], sides[3]).alias("y1"))
    return F.when(finite, box)


def to_pixels(x: Column, page: float, pixels: int, last: int) -> Column:
    """Points to pixels, halves to even, clamped to 0..last."""
    return F.least(F.greatest(F.bround(x * (pixels / page)).cast("long"), F.lit(0)), F.lit(last))


def to_emu(points: Column, scale: float, offset: float) -> Column:
    return F.bround(points * scale + offset).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def hex_colour(number: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(number.bitwiseAND(0xFFFFFF))), 6, "0"))


def luma(number: Column) -> Column:
    """Weighted brightness, in ten-thousandths."""
    red, green, blue = (F.shiftright(number, s).bitwiseAND(255) for s in (16, 8, 0))
    return 2126 * red + 7152 * green + 722 * blue

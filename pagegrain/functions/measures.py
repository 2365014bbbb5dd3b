"""Page measures as column expressions: maps between spaces, page predicates, colours and numbers.

A box is a struct of x0, y0, x1, y1; what cannot be a box is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import EMU_PER_POINT, clamp

INFINITY = float("inf")


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def pixel_box(sides: Column) -> Column:
    """A box with ordered corners from a list of four numbers; null for another length, a null or a NaN. Infinities stay."""
    numbers = F.transform(sides, lambda v: v.cast("double"))
    good = (F.size(numbers) == 4) & F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v))
    at = [F.try_element_at(numbers, F.lit(i)) for i in range(1, 5)]
    return F.when(good, box(F.least(at[0], at[2]), F.least(at[1], at[3]), F.greatest(at[0], at[2]), F.greatest(at[1], at[3])))


def to_points(b: Column, image_width: int, image_height: int, page_width: float, page_height: float) -> Column:
    """Pixels to points: clamped to the image first, then scaled; null if nothing is left."""
    x0, y0 = clamp(b["x0"], 0.0, float(image_width - 1)), clamp(b["y0"], 0.0, float(image_height - 1))
    x1, y1 = clamp(b["x1"], 0.0, float(image_width)), clamp(b["y1"], 0.0, float(image_height))
    sx, sy = page_width / image_width, page_height / image_height
    return F.when((x1 > x0) & (y1 > y0), box(x0 * sx, y0 * sy, x1 * sx, y1 * sy))


def to_pixel_box(b: Column, page_width: float, page_height: float, image_width: int, image_height: int) -> Column:
    """Points to whole pixels, halves to even, clamped so that the far edges may lie on the image's; null if nothing is left."""

    def on(v: Column, scale: float, most: int) -> Column:
        return clamp(F.bround(v * scale), 0.0, float(most))

    sx, sy = image_width / page_width, image_height / page_height
    x0, y0 = on(b["x0"], sx, image_width - 1), on(b["y0"], sy, image_height - 1)
    x1, y1 = on(b["x1"], sx, image_width), on(b["y1"], sy, image_height)
    return F.when((x1 > x0) & (y1 > y0), box(x0, y0, x1, y1))


def scaled(b: Column, sx: Column, sy: Column, tolerance: float = 1e-6) -> Column:
    """Each side times its axis' scale; scales next to 1 change nothing."""
    same = (F.abs(sx - 1.0) < tolerance) & (F.abs(sy - 1.0) < tolerance)
    return F.when(same, b).otherwise(box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy))


def centre_distance(a: Column, b: Column, page_width: float, page_height: float) -> Column:
    """Distance of the centres over the page's diagonal, which is 1 at least."""
    dx = (a["x0"] + a["x1"]) / 2.0 - (b["x0"] + b["x1"]) / 2.0
    dy = (a["y0"] + a["y1"]) / 2.0 - (b["y0"] + b["y1"]) / 2.0
    return F.sqrt(dx * dx + dy * dy) / max(1.0, (page_width * page_width + page_height * page_height) ** 0.5)


def progress(done: Column, total: Column, start: int, end: int) -> Column:
    """Where a stage stands between two whole percentages, halves to even; the end where there is nothing to do."""
    share = clamp(done.cast("double") / F.when(total > 0, total), 0.0, 1.0)
    return F.when(total <= 0, F.lit(end)).otherwise(F.bround(start + (end - start) * share)).cast("long")


def resized(width: Column, height: Column, target: float, mode: str = "long") -> Column:
    """Width and height with the long or short side at the target, whole and 1 at least; null for sides of 0."""
    side = F.least(width, height) if mode == "short" else F.greatest(width, height)
    scale = F.lit(float(target)) / F.when(side > 0, side.cast("double"))
    return F.when((side > 0) & (F.lit(target) > 0), F.struct(F.greatest(F.lit(1.0), F.bround(width * scale)).alias("width"), F.greatest(F.lit(1.0), F.bround(height * scale)).alias("height")))


#: Fixed values of the document model's pixel budget.
PIXEL_FACTOR = 784
LEAST_PIXELS = 130 * PIXEL_FACTOR
MOST_PIXELS = 1280 * PIXEL_FACTOR
BASE_SIDE = 2200


def quantised(pixels: Column) -> Column:
    """A pixel count rounded down to the factor, at least the floor."""
    return F.greatest(F.lit(LEAST_PIXELS), F.floor(F.greatest(pixels, F.lit(LEAST_PIXELS)) / PIXEL_FACTOR) * PIXEL_FACTOR).cast("long")


def pixel_budget(side: Column, shrunk: Column) -> Column:
    """The pixel count for an image that was shrunk to this side; null where the default holds."""
    share = side.cast("double") / BASE_SIDE
    scaled_count = F.floor(F.lit(float(MOST_PIXELS)) * share * share / PIXEL_FACTOR) * PIXEL_FACTOR
    return F.when(shrunk & (side > 0) & (side < BASE_SIDE), F.greatest(F.lit(LEAST_PIXELS), scaled_count)).cast("long")


#: Slide kinds and their ratios, in order of preference.
SLIDE_KINDS = (("screen4x3", 4.0 / 3.0), ("screen16x10", 1.6), ("screen16x9", 16.0 / 9.0))


def slide_kind(width: Column, height: Column, tolerance: float = 0.08) -> Column:
    """The kind with the nearest ratio, the first on ties, ``custom`` beyond the tolerance; null without a size."""
    ratio = width.cast("double") / F.when(height > 0, height)
    away = [F.abs(ratio - r) for _, r in SLIDE_KINDS]
    near = F.least(*away)
    kind = F.when(near > tolerance, "custom")
    for (name, _), distance in zip(SLIDE_KINDS, away, strict=True):
        kind = kind.when(distance == near, name)
    return F.when((width > 0) & (height > 0), kind)


def fitted(page_width: Column, page_height: Column, slide_width: int, slide_height: int) -> Column:
    """Scale and centring offsets of a page on a slide, in EMU; null for a page without a size."""
    w, h = page_width * float(EMU_PER_POINT), page_height * float(EMU_PER_POINT)
    scale = F.least(F.lit(float(slide_width)) / w, F.lit(float(slide_height)) / h)
    return F.when((page_width > 0) & (page_height > 0), F.struct(scale.alias("scale"), ((F.lit(float(slide_width)) - w * scale) / 2.0).alias("dx"), ((F.lit(float(slide_height)) - h * scale) / 2.0).alias("dy")))


def on_slide(b: Column, fit: Column) -> Column:
    """left, top, width and height in whole EMU, halves to even."""
    emu = float(EMU_PER_POINT)

    def whole(v: Column) -> Column:
        return F.bround(v).cast("long")

    return F.struct(
        whole(fit["dx"] + b["x0"] * emu * fit["scale"]).alias("left"),
        whole(fit["dy"] + b["y0"] * emu * fit["scale"]).alias("top"),
        F.greatest(F.lit(0), whole((b["x1"] - b["x0"]) * emu * fit["scale"])).alias("width"),
        F.greatest(F.lit(0), whole((b["y1"] - b["y0"]) * emu * fit["scale"])).alias("height"),
    )


def area_ratio(b: Column, page_width: Column, page_height: Column) -> Column:
    """Share of the page's area; 0 without a box or a page."""
    area = F.greatest(F.lit(0.0), (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))
    whole = F.greatest(F.lit(1.0), page_width.cast("double") * page_height)
    return F.when((page_width > 0) & (page_height > 0) & b.isNotNull(), area / whole).otherwise(0.0)


def near_full_page(b: Column, page_width: Column, page_height: Column, least: float = 0.88, edge: float = 0.015) -> Column:
    """Whether a box is a page-sized background: this share of the area, and at all four edges."""
    tx, ty = F.greatest(F.lit(2.0), edge * page_width), F.greatest(F.lit(2.0), edge * page_height)
    edges = (b["x0"] <= tx) & (b["y0"] <= ty) & (page_width - b["x1"] <= tx) & (page_height - b["y1"] <= ty)
    return F.coalesce((b["x1"] > b["x0"]) & (b["y1"] > b["y0"]) & edges & (area_ratio(b, page_width, page_height) >= least), F.lit(False))


def suppress_box(b: Column, page_width: float, page_height: float, confirmed: Column) -> Column:
    """The box within which text gives way to an image: padded more where the shape is confirmed, clipped to the page."""
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    px = F.when(confirmed, clamp(0.05 * w, 1.5, 8.0)).otherwise(clamp(0.02 * w, 0.8, 3.5))
    py = F.when(confirmed, clamp(0.07 * h, 1.0, 6.0)).otherwise(clamp(0.03 * h, 0.8, 3.0))
    return box(F.greatest(F.lit(0.0), b["x0"] - px), F.greatest(F.lit(0.0), b["y0"] - py), F.least(F.lit(page_width), b["x1"] + px), F.least(F.lit(page_height), b["y1"] + py))


def rgb(colour: Column) -> Column:
    """r, g and b of ``#rrggbb`` or ``rrggbb``; null for anything else."""
    text = F.regexp_replace(F.trim(colour), "^#", "")
    part = [F.conv(F.substring(text, i, 2), 16, 10).cast("int") for i in (1, 3, 5)]
    return F.when(F.regexp_like(text, F.lit("^[0-9a-fA-F]{6}$")), F.struct(*[p.alias(n) for p, n in zip(part, "rgb", strict=True)]))


def brightness(c: Column) -> Column:
    return 0.2126 * c["r"].cast("double") + 0.7152 * c["g"].cast("double") + 0.0722 * c["b"].cast("double")


def square_distance(a: Column, b: Column) -> Column:
    d = [a[n] - b[n] for n in "rgb"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def contrasting(background: Column) -> Column:
    """Black text on a bright ground, white on a dark one."""
    return F.when(brightness(background) >= 130.0, "#000000").otherwise("#ffffff")


def colour_text(value: Column) -> Column:
    """``#rrggbb`` in lower case from the forms that payloads use: a leading # or 0x, three digits, or alpha before."""
    text = F.regexp_replace(F.trim(value), "^(#|0[xX])", "")
    text = F.when(F.length(text) == 8, F.right(text, F.lit(6))).otherwise(text)
    text = F.when(F.length(text) == 3, F.regexp_replace(text, "(.)", "$1$1")).otherwise(text)
    return F.when(F.regexp_like(text, F.lit("^[0-9a-fA-F]{6}$")), F.concat(F.lit("#"), F.lower(text)))


def whole_or(value: Column, default: int, low: int, high: int) -> Column:
    """A whole number from text, the default where there is none, clamped."""
    return F.least(F.greatest(F.coalesce(value.try_cast("long"), F.lit(default)), F.lit(low)), F.lit(high))

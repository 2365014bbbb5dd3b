"""Outlines of regions and region entries from JSON in any of their forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shapes import once


def _kind_of(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).rlike(f"^(?:{kind})")


def _list(value: Column) -> Column:
    return F.when(_kind_of(value, "ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _number(value: Column) -> Column:
    """A number, a flag or a string of digits."""
    return F.coalesce(F.try_variant_get(value, "$", "double"), F.when(_kind_of(value, "BOOLEAN"), F.try_variant_get(value, "$", "boolean").cast("double")))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    whole = x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()
    return F.when(whole, F.array(_point(x0, y0), _point(x1, y0), _point(x1, y1), _point(x0, y1)))


def _or_zero(value: Column) -> Column:
    return F.when(_kind_of(value, "VOID") | (F.try_variant_get(value, "$", "string") == ""), 0.0).otherwise(_number(value))


def _all(values: Column, met) -> Column:
    return (F.size(values) > 0) & F.forall(values, met)


def _is_pair(value: Column) -> Column:
    return F.coalesce(F.size(_list(value)) >= 2, F.lit(False))


def layout_points(text: Column) -> Column:
    """Points x, y of a region in JSON; null where it has none.

    A region is an object with left, top, width and height (null and blank: 0) or two
    corners, a list of points (objects or lists), a flat list of 8 numbers or more in
    pairs, or a list of two corners. Lists with a point that is no number have none.
    """

    def of_object(v: Column) -> Column:
        sized = [_at(v, f"$.{k}") for k in ("left", "top", "width", "height")]
        left, top, width, height = map(_or_zero, sized)
        out = F.lit(None)
        for keys in (("xmin", "ymin", "xmax", "ymax"), ("x0", "y0", "x1", "y1")):
            sides = [_at(v, f"$.{k}") for k in keys]
            out = F.when(F.array_contains(F.array(*(s.isNull() for s in sides)), False) & ~F.array_contains(F.array(*(s.isNull() for s in sides)), True), _corners(*map(_number, sides))).otherwise(out)
        return F.when(~F.array_contains(F.array(*(s.isNull() for s in sized)), True), _corners(left, top, left + width, top + height)).otherwise(out)

    def named(p: Column) -> Column:
        def side(key: str, other: str) -> Column:
            value = _at(p, f"$.{key}")
            return _number(F.when(value.isNotNull() & ~_kind_of(value, "VOID"), value).otherwise(_at(p, f"$.{other}")))

        return _point(side("x", "left"), side("y", "top"))

    def of_list(v: Column) -> Column:
        values = _list(v)
        n = F.size(values)
        numbers = F.transform(values, _number)
        flat = _all(values, lambda p: _kind_of(p, "BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN"))
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)), F.lit(2)), lambda i: _point(F.get(numbers, i), F.get(numbers, i + 1)))
        listed = F.when(_all(values, lambda p: _kind_of(p, "OBJECT")), F.transform(values, named)).when(
            _all(values, _is_pair), F.transform(values, lambda p: _point(_number(_at(p, "$[0]")), _number(_at(p, "$[1]"))))
        ).when(flat & (n >= 8) & (n % 2 == 0), pairs).when(flat & (n == 4), _corners(*(F.get(numbers, F.lit(i)) for i in range(4))))
        return once(listed, lambda points: F.when(F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), points))

    return once(F.try_parse_json(text), lambda v: F.when(_kind_of(v, "OBJECT"), of_object(v)).when(_kind_of(v, "ARRAY"), of_list(v)))


def layout_kind(text: Column, source: Column) -> Column:
    """``polygon`` for a list of points or of 8 values or more in pairs, and where the source says so, else ``bbox``."""

    def kind(v: Column) -> Column:
        values = _list(v)
        n = F.size(values)
        points = _all(values, lambda p: _kind_of(p, "OBJECT")) | _all(values, _is_pair) | ((n >= 8) & (n % 2 == 0))
        return F.when((source == "polygon_points") | F.coalesce(points, F.lit(False)), "polygon").otherwise("bbox")

    return once(F.try_parse_json(text), kind)


def region_entry(text: Column) -> Column:
    """x0, y0, x1, y1, label, score, kind and points of a region entry in JSON: a list of four sides or an object with one.

    Null without four finite sides, which are put in order. Three finite points or more
    make it a polygon, whatever kind it names.
    """

    def entry(v: Column) -> Column:
        inside = _kind_of(v, "OBJECT")
        given = _at(v, "$.bbox_pt")
        box = F.when(~inside, v).when(given.isNotNull() & ~_kind_of(given, "VOID"), given).otherwise(_at(v, "$.bbox"))
        sides = F.transform(_list(box), _number)
        spots = _at(v, "$.geometry_points_pt")
        spots = _list(F.when(spots.isNotNull() & ~_kind_of(spots, "VOID"), spots).otherwise(_at(v, "$.geometry_points")))
        points = F.transform(spots, lambda p: F.when(_is_pair(p), _point(_number(_at(p, "$[0]")), _number(_at(p, "$[1]")))))
        whole = F.forall(points, lambda p: _finite(p["x"]) & _finite(p["y"])) & (F.size(points) >= 3)
        named = F.lower(F.trim(F.try_variant_get(v, "$.geometry_kind", "string")))

        def out(s: Column) -> Column:
            a, b, c, d = (F.get(s, F.lit(i)) for i in range(4))
            kind = F.when(whole, "polygon").when(named != "", named)
            found = F.struct(
                F.least(a, c).alias("x0"), F.least(b, d).alias("y0"), F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("y1"),
                F.try_variant_get(v, "$.label", "string").alias("label"), F.try_variant_get(v, "$.score", "double").alias("score"), kind.alias("kind"), F.when(whole, points).alias("points"),
            )
            return F.when((F.size(s) == 4) & F.forall(s, _finite), found)

        return once(sides, out)

    return once(F.try_parse_json(text), entry)


def _finite(value: Column) -> Column:
    return F.coalesce(F.abs(value) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(value, F.lit(0.0)))

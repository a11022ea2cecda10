"""Plane geometry in points as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inches in one unit's terms, decimals shown and label of each unit.
PER_INCH = {"points": 72.0, "inches": 1.0, "mm": 25.4, "cm": 2.54, "meters": 0.0254}
DECIMALS = {"points": 1, "inches": 2, "mm": 1, "cm": 2, "meters": 3}
LABELS = {"points": "pt", "inches": "in", "mm": "mm", "cm": "cm", "meters": "m"}


def distance(a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.sqrt(dx * dx + dy * dy)


def _edges(vertices: Column) -> Column:
    following = F.concat(F.slice(vertices, 2, F.greatest(F.size(vertices) - 1, F.lit(0))), F.slice(vertices, 1, 1))
    return F.arrays_zip(vertices.alias("a"), following.alias("b"))


def perimeter(vertices: Column) -> Column:
    """Length around a closed polygon of struct<x,y>; 0.0 below two vertices."""
    total = F.aggregate(_edges(vertices), F.lit(0.0), lambda acc, e: acc + distance(e["a"], e["b"]))
    return F.when(F.size(vertices) < 2, 0.0).otherwise(total)


def area(vertices: Column) -> Column:
    """Shoelace area of a closed polygon; 0.0 below three vertices."""
    total = F.aggregate(
        _edges(vertices), F.lit(0.0), lambda acc, e: acc + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    )
    return F.when(F.size(vertices) < 3, 0.0).otherwise(F.abs(total) / 2.0)


def _factor(unit: Column) -> Column:
    value = F.lit(None).cast("double")
    for name, per_inch in PER_INCH.items():
        value = F.when(unit == name, per_inch).otherwise(value)
    return value


def convert(value: Column, source: Column, target: Column) -> Column:
    """A length in another unit; null for unknown units."""
    points = F.when(source == "points", value).otherwise(value * 72.0 / _factor(source))
    changed = F.when(target == "points", points).otherwise(points / 72.0 * _factor(target))
    return F.when(source == target, value).otherwise(changed)


def format_length(value: Column, unit: Column) -> Column:
    text = F.lit(None).cast("string")
    for name, decimals in DECIMALS.items():
        text = F.when(unit == name, F.format_string(f"%.{decimals}f {LABELS[name]}", value)).otherwise(text)
    return text


def _box(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def _by_rotation(rotation: Column, cases: dict[int, Column]) -> Column:
    chosen = F.when(rotation == 0, cases[0])
    for degrees in (90, 180, 270):
        chosen = chosen.when(rotation == degrees, cases[degrees])
    return chosen


def css_to_pdf(x, y, w, h, page_w, page_h, rotation) -> Column:
    """Top-left canvas box to bottom-left page box under the viewer's rotation."""
    return _by_rotation(
        rotation,
        {
            0: _box(x, page_h - y - h, w, h),
            90: _box(page_w + y, -x - h, w, h),
            180: _box(page_w - x, page_h - y - h, w, h),
            270: _box(y, page_h - x - h, w, h),
        },
    )


def pdf_to_css(x, y, w, h, page_w, page_h, rotation) -> Column:
    """The inverse of css_to_pdf."""
    return _by_rotation(
        rotation,
        {
            0: _box(x, page_h - y - h, w, h),
            90: _box(-y - h, x - page_w, w, h),
            180: _box(page_w - x, page_h - y - h, w, h),
            270: _box(page_h - y - h, x, w, h),
        },
    )


def round_trip_ok(x, y, w, h, page_w, page_h, rotation) -> Column:
    """Is canvas to page and back the same place within 0.01 points?"""
    there = css_to_pdf(x, y, w, h, page_w, page_h, rotation)
    back = pdf_to_css(there["x"], there["y"], w, h, page_w, page_h, rotation)
    return (F.abs(back["x"] - x) <= 0.01) & (F.abs(back["y"] - y) <= 0.01)


def rotate_point(x, y, w, h, degrees) -> Column:
    """struct<x,y> of a point after the page turns by a multiple of 90 degrees."""
    turn = F.pmod(degrees, F.lit(360))
    point = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    return _by_rotation(turn, {0: point(x, y), 90: point(y, w - x), 180: point(w - x, h - y), 270: point(h - y, x)})


def span_to_css(rect: Column, page_w, page_h, rotation) -> Column:
    """Content-space rect to top-left box on the displayed page (its sizes as shown)."""
    sideways = rotation.isin(90, 270)
    raw_w = F.when(sideways, page_h).otherwise(page_w)
    raw_h = F.when(sideways, page_w).otherwise(page_h)
    x, y, w, h = rect["x0"], rect["y0"], rect["x1"] - rect["x0"], rect["y1"] - rect["y0"]
    turned = _by_rotation(
        rotation,
        {0: _box(x, y, w, h), 90: _box(y, raw_w - x - w, h, w), 180: _box(raw_w - x - w, raw_h - y - h, w, h),
         270: _box(raw_h - y - h, x, h, w)},
    )
    return F.struct(
        turned["x"].alias("left"),
        (page_h - turned["y"] - turned["h"]).alias("top"),
        turned["w"].alias("width"),
        turned["h"].alias("height"),
    )


def from_crop_frame(x, y, crop_x, crop_y) -> Column:
    """Crop-frame point to media-frame point."""
    return F.struct((x + crop_x).alias("x"), (y + crop_y).alias("y"))


def to_crop_frame(x, y, crop_x, crop_y) -> Column:
    return F.struct((x - crop_x).alias("x"), (y - crop_y).alias("y"))

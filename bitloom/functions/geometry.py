"""Column helpers for boxes: structs of x, y, x2, y2, y growing upward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NARROW = 1e-9


def box(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def _span(low: Column, high: Column) -> Column:
    return F.greatest(high - low, F.lit(0.0))


def area(a: Column) -> Column:
    return _span(a["x"], a["x2"]) * _span(a["y"], a["y2"])


def x_overlap(a: Column, b: Column) -> Column:
    return _span(F.greatest(a["x"], b["x"]), F.least(a["x2"], b["x2"]))


def y_overlap(a: Column, b: Column) -> Column:
    return _span(F.greatest(a["y"], b["y"]), F.least(a["y2"], b["y2"]))


def intersection(a: Column, b: Column) -> Column:
    return x_overlap(a, b) * y_overlap(a, b)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def coverage(a: Column, b: Column) -> Column:
    """How much of a lies in b; 0 for an empty a."""
    return _share(intersection(a, b), area(a))


def y_coverage(a: Column, b: Column) -> Column:
    """Vertical overlap over a's height."""
    return _share(y_overlap(a, b), a["y2"] - a["y"])


def y_min_coverage(a: Column, b: Column) -> Column:
    """Vertical overlap over the smaller height."""
    return _share(y_overlap(a, b), F.least(a["y2"] - a["y"], b["y2"] - b["y"]))


def iou(a: Column, b: Column) -> Column:
    return _share(intersection(a, b), area(a) + area(b) - intersection(a, b))


def box_distance(a: Column, b: Column) -> Column:
    """The shortest gap; 0 for boxes that touch."""
    dx = F.greatest(b["x"] - a["x2"], a["x"] - b["x2"], F.lit(0.0))
    dy = F.greatest(b["y"] - a["y2"], a["y"] - b["y2"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def expanded(a: Column, by: float) -> Column:
    return box(a["x"] - by, a["y"] - by, a["x2"] + by, a["y2"] + by)


def contained(a: Column, b: Column, threshold: float = 0.95, tolerance: float = 2.0) -> Column:
    """Whether b, made larger by the tolerance, holds that much of a."""
    return coverage(a, expanded(b, tolerance)) >= threshold


def is_newline(previous: Column, current: Column, width: Column, widths: float = 10.0) -> Column:
    """Below the previous character, or so many widths left of it."""
    return (current["y2"] <= previous["y"]) | (current["x2"] < previous["x"] - width * widths)


def _gap(a: Column, b: Column, low: str, high: str) -> Column:
    """How far two intervals are apart; negative where they share more than a point."""
    return F.greatest(b[low] - a[high], a[low] - b[high])


def x_adjacent(a: Column, b: Column, tolerance: float = 2.0) -> Column:
    """Beside one another within the tolerance, or sharing width."""
    return _gap(a, b, "x", "x2") <= tolerance


def x_contained(a: Column, b: Column) -> Column:
    """One box's width lies within the other's."""
    inside = lambda p, q: (p["x"] >= q["x"]) & (p["x2"] <= q["x2"])
    return inside(a, b) | inside(b, a)


def y_intersects(a: Column, b: Column, tolerance: float = 1.0) -> Column:
    """Sharing height, or apart by no more than the tolerance."""
    return _gap(a, b, "y", "y2") <= tolerance


def y_iou(a: Column, b: Column) -> Column:
    """Shared height over the height of both."""
    return _share(y_overlap(a, b), (a["y2"] - a["y"]) + (b["y2"] - b["y"]) - y_overlap(a, b))


def cells(a: Column, size: float) -> Column:
    """The grid cells that a box touches, as (cx, cy)."""
    low = lambda c: F.floor(c / size)
    cell = lambda cx, cy: F.struct(cx.alias("cx"), cy.alias("cy"))
    across = F.sequence(low(a["x"]), F.greatest(low(a["x2"]), low(a["x"])))
    up = F.sequence(low(a["y"]), F.greatest(low(a["y2"]), low(a["y"])))
    one = (low(a["x2"]) <= low(a["x"])) & (low(a["y2"]) <= low(a["y"]))  # as nearly all small boxes have, which need no lambdas
    return F.when(one, F.array(cell(low(a["x"]), low(a["y"])))).otherwise(F.flatten(F.transform(across, lambda cx: F.transform(up, lambda cy: cell(cx, cy)))))

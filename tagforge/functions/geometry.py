"""Boxes, corners and layout zones as array expressions.  A null box gives nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The frame rate of a video that tells none; the least side of a usable tag image, and the share of its height above the colored part.
DEFAULT_RATE = 30.0
LEAST_SIDE = 10
TOP_SHARE = 0.55


def corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Top left, top right, bottom right, bottom left."""
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    return F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2))


def axis(points: Column, i: int) -> Column:
    return F.transform(points, lambda p: p[i])


def finite(points: Column) -> Column:
    """The points, or null if one of their numbers is missing or not finite."""
    whole = F.forall(points, lambda p: F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return F.when(whole, points)


def bounding_box(points: Column) -> Column:
    """Struct x_min, y_min, x_max, y_max, cut to integers toward zero."""
    side = lambda f, i: f(axis(points, i)).cast("int")
    return F.struct(side(F.array_min, 0).alias("x_min"), side(F.array_min, 1).alias("y_min"), side(F.array_max, 0).alias("x_max"), side(F.array_max, 1).alias("y_max"))


def edge_length(points: Column, i: int, j: int) -> Column:
    d = lambda k: points[i][k] - points[j][k]
    return F.sqrt(d(0) * d(0) + d(1) * d(1))


def upright_size(points: Column) -> Column:
    """Struct w, h: the longer of each two opposite edges, cut to integers."""
    w = F.greatest(edge_length(points, 2, 3), edge_length(points, 1, 0))
    h = F.greatest(edge_length(points, 1, 2), edge_length(points, 0, 3))
    return F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"))


def usable(size: Column) -> Column:
    return (size["w"] >= LEAST_SIDE) & (size["h"] >= LEAST_SIDE)


def center(points: Column, i: int) -> Column:
    """The mean of the four corners."""
    return reduce(lambda a, b: a + b, (points[j][i] for j in range(4))) / 4


def extent(points: Column, i: int) -> Column:
    return F.array_max(axis(points, i)) - F.array_min(axis(points, i))


def is_top(points: Column, height: Column) -> Column:
    return center(points, 1) < (height * TOP_SHARE).cast("int")


def is_left(points: Column, width: Column) -> Column:
    return center(points, 0) < width / 2


def turned(points: Column, quarters: Column, height: Column, width: Column) -> Column:
    """Points of an image turned clockwise by 0 to 3 quarters."""
    k = F.pmod(quarters, F.lit(4))
    new = lambda p: (
        F.when(k == 1, F.array(height - 1 - p[1], p[0]))
        .when(k == 2, F.array(width - 1 - p[0], height - 1 - p[1]))
        .when(k == 3, F.array(p[1], width - 1 - p[0]))
        .otherwise(p)
    )
    return F.transform(points, new)


def upright_points(points: Column, height: Column, width: Column) -> Column:
    """Aspect mode: an image higher than wide is turned counter-clockwise, and its points with it."""
    return F.when(height > width, turned(points, F.lit(3), height, width)).otherwise(points)


def frame_ms(frame: Column, fps: Column) -> Column:
    """Milliseconds of a frame, in double and cut; without a frame rate, 40 ms a frame."""
    return F.when(fps > 0, frame / fps * 1000).otherwise(frame * F.lit(40.0)).cast("long")


def frame_rate(fps: Column) -> Column:
    """A video's frame rate; one that is missing or 0 is DEFAULT_RATE."""
    return F.coalesce(F.nullif(fps.cast("double"), F.lit(0.0)), F.lit(DEFAULT_RATE))

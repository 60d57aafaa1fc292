"""Pixel expressions: 8-bit hue, saturation and value, color masks, gray levels, edges and similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The share of pixels that makes a tag colored, and the constants of structural similarity.
COLORED = 0.05
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def hsv(b: Column, g: Column, r: Column) -> Column:
    """Struct h (0 to 179), s, v (0 to 255), rounded half up."""
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    d = (v - low).cast("double")
    angle = F.when(v == low, F.lit(0.0)).when(v == r, 30 * (g - b) / d).when(v == g, 60 + 30 * (b - r) / d).otherwise(120 + 30 * (r - g) / d)
    whole = lambda x: F.floor(x + F.lit(0.5)).cast("int")
    s = F.when(v == 0, F.lit(0.0)).otherwise(255 * d / v)
    return F.struct(F.pmod(whole(F.when(angle < 0, angle + 180).otherwise(angle)), F.lit(180)).alias("h"), whole(s).alias("s"), v.cast("int").alias("v"))


# The hues of red and yellow, with their least saturation and value.
RED, YELLOW, LEAST_S, LEAST_V = ((0, 10), (160, 180)), ((20, 35),), 70, 50


def _in_hues(p: Column, hues) -> Column:
    near = reduce(lambda a, b: a | b, (p["h"].between(*x) for x in hues))
    return near & (p["s"] >= LEAST_S) & (p["v"] >= LEAST_V)


def is_red(p: Column) -> Column:
    return _in_hues(p, RED)


def is_yellow(p: Column) -> Column:
    return _in_hues(p, YELLOW)


def gray(b: Column, g: Column, r: Column) -> Column:
    return F.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5).cast("int")


def edges(grid: Column, rows: int, cols: int) -> Column:
    """The Laplacian of a row-major grid; borders mirror without repeating the edge pixel."""
    mirror = lambda i, n: F.when(i < 0, F.lit(min(1, n - 1))).when(i >= n, F.lit(max(n - 2, 0))).otherwise(i)

    def at(i: Column) -> Column:
        y, x = F.floor(i / cols).cast("int"), F.pmod(i, F.lit(cols))
        cell = lambda a, b: F.get(grid, (mirror(a, rows) * cols + mirror(b, cols)).cast("int"))
        return cell(y - 1, x) + cell(y + 1, x) + cell(y, x - 1) + cell(y, x + 1) - 4 * F.get(grid, i)

    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), at)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def variance(values: Column) -> Column:
    """Population variance of an array."""
    return F.get(F.transform(F.array(mean(values)), lambda m: total(F.transform(values, lambda x: (x - m) * (x - m))) / F.size(values)), 0)


def sharpness(grid: Column, rows: int, cols: int) -> Column:
    """Variance of the edges; null where the grid has another size."""
    e = F.get(F.transform(F.array(edges(grid, rows, cols)), variance), 0)
    return F.when(F.size(grid) == rows * cols, e)


def similarity(a_mean: Column, a_var: Column, b_mean: Column, b_var: Column, cov: Column) -> Column:
    """Structural similarity of two gray images from their moments."""
    return (2 * a_mean * b_mean + C1) * (2 * cov + C2) / ((a_mean * a_mean + b_mean * b_mean + C1) * (a_var + b_var + C2))


def turned_grid(grid: Column, rows: Column, cols: Column, quarters: Column) -> Column:
    """The row-major grid of an image turned clockwise by 0 to 3 quarters; its sides swap at odd ones."""
    k = F.pmod(quarters, F.lit(4))
    high, wide = F.when(k % 2 == 0, rows).otherwise(cols), F.when(k % 2 == 0, cols).otherwise(rows)

    def source(i: Column) -> Column:
        y, x = F.floor(i / wide), i % wide
        place = F.when(k == 1, (rows - 1 - x) * cols + y).when(k == 2, (rows - 1 - y) * cols + cols - 1 - x).when(k == 3, x * cols + cols - 1 - y).otherwise(i)
        return F.get(grid, place.cast("int"))

    return F.when((high > 0) & (wide > 0), F.transform(F.sequence(F.lit(0), high * wide - 1), source)).otherwise(grid)


def resized_grid(grid: Column, rows: Column, cols: Column, to_rows: Column, to_cols: Column) -> Column:
    """A row-major grid in another size: bilinear between pixel centers, borders repeated, rounded half up."""
    def place(i: Column, n: Column, to_n: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(n - 1.0, (i + 0.5) * n / to_n - 0.5))

    def value(i: Column) -> Column:
        y, x = place(F.floor(i / to_cols), rows, to_rows), place(i % to_cols, cols, to_cols)
        y0, x0 = F.floor(y), F.floor(x)
        cell = lambda a, b: F.get(grid, (F.least(a, rows - 1) * cols + F.least(b, cols - 1)).cast("int"))
        above = cell(y0, x0) * (1 - (x - x0)) + cell(y0, x0 + 1) * (x - x0)
        below = cell(y0 + 1, x0) * (1 - (x - x0)) + cell(y0 + 1, x0 + 1) * (x - x0)
        return F.floor(above * (1 - (y - y0)) + below * (y - y0) + 0.5).cast("double")

    return F.transform(F.sequence(F.lit(0), to_rows * to_cols - 1), value)

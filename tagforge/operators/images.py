"""Operators on images, either as pixels (one row each) or as arrays of gray levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagforge.functions import pixels


def tag_color(points: DataFrame, image: str = "image_id", images: DataFrame | None = None) -> DataFrame:
    """points: image, b, g, r -> image, n, red_share, yellow_share, color.

    Red is asked before yellow; a share must exceed COLORED; of images, those without pixels are unknown, and without
    that table they have no row.  Counts are combined before the shuffle.
    """
    p = pixels.hsv(F.col("b").cast("int"), F.col("g").cast("int"), F.col("r").cast("int"))
    seen = points.select(image, p.alias("p")).groupBy(image).agg(F.count("*").alias("n"), F.count_if(pixels.is_red(F.col("p"))).alias("red"), F.count_if(pixels.is_yellow(F.col("p"))).alias("yellow"))
    seen = seen.withColumns({"red_share": F.col("red") / F.col("n"), "yellow_share": F.col("yellow") / F.col("n")})
    color = F.when(F.col("red_share") > pixels.COLORED, "red").when(F.col("yellow_share") > pixels.COLORED, "yellow").otherwise("unknown")
    out = seen.select(image, "n", "red_share", "yellow_share", color.alias("color"))
    if images is None:
        return out
    return images.select(image).distinct().join(out, image, "left").fillna({"n": 0, "red_share": 0.0, "yellow_share": 0.0, "color": "unknown"})


def best_turn(points: DataFrame, image: str = "image_id") -> DataFrame:
    """points: image, h, w, y, x, colored -> image, quarters, score.

    The score of a turn is the colored share of the lower half less that of the upper one (split at
    height div 2); the least turn wins ties; images under 4 x 4 score 0.  All four turns are
    conditional counts of one aggregation.
    """
    h, w = F.col("h"), F.col("w")
    row = [F.col("y"), F.col("x"), h - 1 - F.col("y"), w - 1 - F.col("x")]
    high = [h, w, h, w]
    parts = []
    for k in range(4):
        upper = row[k] < F.floor(high[k] / 2)
        parts += [F.count_if(upper).alias(f"n{k}"), F.count_if(upper & F.col("colored")).alias(f"c{k}")]
    seen = points.groupBy(image, "h", "w").agg(F.count("*").alias("n"), F.count_if("colored").alias("c"), *parts)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    score = lambda k: F.when((h < 4) | (w < 4), F.lit(0.0)).otherwise(share(F.col("c") - F.col(f"c{k}"), F.col("n") - F.col(f"n{k}")) - share(F.col(f"c{k}"), F.col(f"n{k}")))
    turns = F.array(*(F.struct(score(k).alias("score"), F.lit(-k).alias("k")) for k in range(4)))
    return seen.withColumn("best", F.array_max(turns)).select(image, (-F.col("best.k")).alias("quarters"), F.col("best.score").alias("score"))


def consecutive_similarity(images: DataFrame, order: str, grid: str, rows: int | None = None) -> DataFrame:
    """Structural similarity (one window) of each image with the one whose `order` number is one less.

    Given the number of rows of all images, one of another width is resized first; without it, and
    where a grid has no whole number of columns, pairs of different sizes are left out.
    """
    own = images.select(F.col(order).alias("i"), F.col(grid).cast("array<double>").alias("g"))
    before = own.select((F.col("i") + 1).alias("i"), F.col("g").alias("g0"))
    both = own.join(before, "i")
    if rows is not None:
        cols = lambda c: F.floor(F.size(c) / rows).cast("int")
        whole = (F.size("g") > 0) & (F.size("g0") > 0) & (F.size("g") % rows == 0) & (F.size("g0") % rows == 0)
        both = both.withColumn("g0", F.when(whole & (F.size("g") != F.size("g0")), pixels.resized_grid(F.col("g0"), F.lit(rows), cols("g0"), F.lit(rows), cols("g"))).otherwise(F.col("g0")))
    moments = {"m": pixels.mean(F.col("g")), "v": pixels.variance(F.col("g")), "m0": pixels.mean(F.col("g0")), "v0": pixels.variance(F.col("g0"))}
    both = both.where(F.size("g") == F.size("g0")).withColumns(moments)
    cov = pixels.mean(F.zip_with("g", "g0", lambda a, b: a * b)) - F.col("m") * F.col("m0")
    return both.select(F.col("i").alias(order), pixels.similarity(F.col("m"), F.col("v"), F.col("m0"), F.col("v0"), cov).alias("similarity"))

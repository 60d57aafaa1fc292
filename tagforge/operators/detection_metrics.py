"""Precision, recall and average precision of detected boxes against true ones.

1. Boxes of an image and label that overlap are found by an equality join on the cells of a grid that both touch; a pair is
   kept in the one cell that holds the corner where its intersection begins.
2. Predictions take truths in order of confidence, each the free one that it overlaps most.  That is the one stable matching of
   predictions that like overlap and truths that like confidence, so it comes from rounds of joins: every prediction asks its
   best truth, every truth turns down all but the most confident, until nobody is turned down.
3. Predictions are ranked by confidence with running sums over ranges of the order, and the area under the interpolated curve is
   taken at 101 recalls.

Edge cases: boxes with a null or not finite number, or without an area, overlap nothing and count; equal overlaps go to the lesser truth, equal
confidences to the lesser prediction, a null confidence comes last; a label without truths has null recall and area, one without
predictions null precision and area 0; ids are unique in their table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagforge.operators.ordered import numbered
from tagforge.sources.stage import staged, unstage

#: The overlaps at which detections count, and the side of a cell of the grid in pixels.
LEVELS = tuple((50 + 5 * i) / 100 for i in range(10))
CELL = 128
SIDES = ("x1", "y1", "x2", "y2")


def _celled(boxes: DataFrame, name: str, cell: float) -> DataFrame:
    side = {c: F.col(c).cast("double") for c in SIDES}
    good = (side["x1"] < side["x2"]) & (side["y1"] < side["y2"])
    for c in side.values():
        good = good & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e12)
    rows = boxes.where(good).select("image", "label", F.col("id").alias(name), *(s.alias(f"{name}_{c}") for c, s in side.items()))
    span = lambda a, z: F.explode(F.sequence(F.floor(F.col(f"{name}_{a}") / cell), F.floor(F.col(f"{name}_{z}") / cell)))
    return rows.withColumn("cell_x", span("x1", "x2")).withColumn("cell_y", span("y1", "y2"))


def overlaps(predictions: DataFrame, truths: DataFrame, least: float = LEVELS[0], cell: float = CELL) -> DataFrame:
    """image, label, p, t, overlap: pairs whose intersection is `least` of their union or more."""
    both = _celled(predictions, "p", cell).join(_celled(truths, "t", cell), ["image", "label", "cell_x", "cell_y"])
    at = lambda f, c: f(F.col(f"p_{c}"), F.col(f"t_{c}"))
    left, top, right, bottom = at(F.greatest, "x1"), at(F.greatest, "y1"), at(F.least, "x2"), at(F.least, "y2")
    own = (F.floor(left / cell) == F.col("cell_x")) & (F.floor(top / cell) == F.col("cell_y")) & (left < right) & (top < bottom)
    area = lambda n: (F.col(f"{n}_x2") - F.col(f"{n}_x1")) * (F.col(f"{n}_y2") - F.col(f"{n}_y1"))
    common = (right - left) * (bottom - top)
    return both.where(own).withColumn("overlap", common / (area("p") + area("t") - common)).where(F.col("overlap") >= least).select("image", "label", "p", "t", "overlap")


def matched(pairs: DataFrame) -> DataFrame:
    """pairs: level, p, t, overlap, conf -> level, p, t of the matching in order of confidence."""
    worth = F.struct(F.col("conf").isNotNull().alias("known"), "conf", (-F.col("p")).alias("first"))
    left = staged(pairs.select("level", "p", "t", "overlap", "conf"), "match-pairs")
    while True:
        asked = left.groupBy("level", "p").agg(F.max(F.struct("overlap", (-F.col("t")).alias("t"), "conf")).alias("x")).select("level", "p", (-F.col("x.t")).alias("t"), "x.conf")
        held = staged(asked.groupBy("level", "t").agg(F.max_by("p", worth).alias("holder"), F.max(worth).alias("best"), F.count("*").alias("n")), "match-held")
        if not held.where("n > 1").limit(1).count():
            return held.select("level", F.col("holder").alias("p"), "t")
        # a truth never goes back to a less confident prediction
        rest = left.join(held.select("level", "t", "best"), ["level", "t"], "left").where(F.col("best").isNull() | (worth >= F.col("best"))).drop("best")
        before, left = left, staged(rest, "match-pairs")
        unstage(before)


def curve(ranked: DataFrame) -> Column:
    """The area at 101 recalls from best: the greatest precision of each hundredth of recall that was reached."""
    reached = lambda g: F.coalesce(F.array_max(F.transform(F.filter("best", lambda b: b["at"] >= g), lambda b: b["precision"])), F.lit(0.0))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(100)), reached), F.lit(0.0), lambda a, x: a + x) / 101


def average_precision(predictions: DataFrame, truths: DataFrame, levels: tuple[float, ...] = LEVELS, cell: float = CELL, parts: int | None = None) -> DataFrame:
    """predictions: image, label, id, conf, x1..y2; truths: image, label, id, x1..y2 -> a row for each label and level of overlap:
    n_truths, n_predictions, n_matched, precision, recall, average_precision."""
    every = F.explode(F.array(*map(F.lit, levels)))
    found = overlaps(predictions, truths, min(levels), cell).join(predictions.select(F.col("id").alias("p"), "conf"), "p")
    hits = matched(found.withColumn("level", every).where(F.col("overlap") >= F.col("level")))
    # order, and the number of each prediction in it: labels one after the other
    order = [F.col("label"), F.col("conf").desc_nulls_last(), F.col("id")]
    ranked = staged(numbered(predictions.select("label", F.col("id").alias("id"), "conf"), order, parts=parts), "ranked")
    sizes = ranked.groupBy("label").agg(F.count("*").alias("n_predictions"), F.min("place").alias("begin"))
    good = numbered(hits.join(ranked.select(F.col("id").alias("p"), F.col("label"), F.col("place")), "p").select("level", "label", "place"), [F.col("level"), F.col("label"), F.col("place")], "hit", parts)
    good = staged(good, "hits")
    starts = good.groupBy("level", "label").agg(F.count("*").alias("n_matched"), F.min("hit").alias("first"))
    n_truths = truths.groupBy("label").agg(F.count("*").alias("n_truths"))
    labels = staged(n_truths.join(sizes, "label", "full").fillna(0, ["n_truths", "n_predictions"]), "labels")
    point = good.join(starts, ["level", "label"]).join(labels, "label").where("n_truths > 0").withColumn("k", F.col("hit") - F.col("first") + 1)
    point = point.select("level", "label", F.floor(F.col("k") * 100 / F.col("n_truths")).cast("int").alias("at"), (F.col("k") / (F.col("place") - F.col("begin") + 1)).alias("precision"))
    best = point.groupBy("level", "label", "at").agg(F.max("precision").alias("precision")).groupBy("level", "label").agg(F.collect_list(F.struct("at", "precision")).alias("best"))  # 101 at most
    out = labels.withColumn("level", every).join(starts.drop("first"), ["level", "label"], "left").join(best, ["level", "label"], "left")
    hit = F.coalesce("n_matched", F.lit(0))
    area = F.when(F.col("n_truths") > 0, F.when(F.col("best").isNull(), 0.0).otherwise(curve(out)))
    share = lambda n: F.try_divide(hit, F.nullif(F.col(n), F.lit(0)))
    return out.select("label", "level", "n_truths", "n_predictions", hit.alias("n_matched"), share("n_predictions").alias("precision"), share("n_truths").alias("recall"), area.alias("average_precision"))


def mean_average_precision(scores: DataFrame) -> DataFrame:
    """One row: the means over labels with truths at the least level, and over all levels."""
    known = scores.where("average_precision is not null")
    low = known.agg(F.min("level").alias("least"))
    both = known.join(F.broadcast(low), F.col("level") >= F.col("least"))  # one row
    return both.agg(F.avg(F.when(F.col("level") == F.col("least"), F.col("average_precision"))).alias("map_least"), F.avg("average_precision").alias("map_all"))

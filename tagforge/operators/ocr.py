"""Recognized text in the forms that recognizers give, as the lines that the fields are parsed from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINES = "array<struct<bbox:array<array<double>>,text:string,conf:double>>"
#: A fixed value: the box of a line for which the recognizer gave none.
NO_BOX = [[0.0, 0.0]] * 4


def _line(bbox: Column, text: Column, conf: Column) -> Column:
    return F.struct(bbox.cast("array<array<double>>").alias("bbox"), text.cast("string").alias("text"), conf.cast("double").alias("conf"))


def lines_of_lists(texts: Column, scores: Column, boxes: Column) -> Column:
    """Parallel lists of one image: a missing score is 0, a missing box all zeros; null texts give no lines."""
    none = F.array(*(F.array(*map(F.lit, p)) for p in NO_BOX))
    line = lambda t, i: _line(F.coalesce(F.get(boxes, i), none), t, F.coalesce(F.get(scores, i), F.lit(0.0)))
    return F.coalesce(F.transform(texts, line), F.expr(f"cast(array() as {LINES})"))


def lines_of_pairs(items: Column) -> Column:
    """The older form, an array of (bbox, (text, conf)); items of any other shape have nulls and are left out."""
    whole = F.filter(items, lambda x: x["bbox"].isNotNull() & x["line"].isNotNull())
    return F.coalesce(F.transform(whole, lambda x: _line(x["bbox"], x["line"]["text"], x["line"]["conf"])), F.expr(f"cast(array() as {LINES})"))


def lines_of_images(has_image: Column, lines: Column) -> Column:
    """Only tags with an image are read; the others have no lines."""
    return F.when(has_image, lines).otherwise(F.expr(f"cast(array() as {LINES})"))

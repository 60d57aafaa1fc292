"""Comparison of records with hand-made labels by value: the two tables have no common key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagforge.functions import text


def plain_value(value: Column) -> Column:
    """A value as compared: stripped, with a decimal point; '' if missing."""
    return F.replace(text.strip(value.cast("string")), F.lit(","), F.lit("."))


def matched(rows: DataFrame, labels: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """pairs: column of rows -> column of labels.  One row a pair: field, label, n (values that aren't
    missing) and n_found (those that some label has)."""
    values = lambda table, names: table.select(F.explode(F.array(*(F.struct(F.lit(field).alias("field"), plain_value(F.col(c)).alias("value")) for field, c in names))).alias("x")).select("x.*").where("value <> ''")
    known = values(labels, pairs.items()).distinct().withColumn("known", F.lit(1))
    seen = values(rows, [(c, c) for c in pairs]).groupBy("field", "value").agg(F.count("*").alias("n"))
    found = seen.join(known, ["field", "value"], "left").groupBy("field").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)).alias("n_found"))
    every = rows.sparkSession.createDataFrame(list(pairs.items()), "field string, label string")
    return every.join(found, "field", "left").select("field", "label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_found", F.lit(0)).alias("n_found"))

"""Rows in one order over many tasks: numbered, or written as parts that follow each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagforge.sources.stage import staged


def numbered(rows: DataFrame, keys: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """rows with the number of each in the order of keys, from 0; rows of equal keys are numbered in any order.

    Rows are sorted by ranges of keys, the ranges counted, and each row numbered inside its range: no task holds more
    than one range, and only a count a range meets in one.  Spark chooses the number of ranges unless parts is given.
    """
    taken = {c.lower() for c in rows.columns}
    part, at = (next(n for n in (f"__{x}{i}" for i in range(len(taken) + 1)) if n not in taken) for x in ("part", "at"))
    ranged = rows.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys)
    held = staged(ranged.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "numbered")
    sizes = held.groupBy(part).agg(F.count("*").alias("n"), F.min(at).alias("first"))  # a row a task
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(part).alias("p"), F.col("first"), before.alias("before"))
    both = held.join(F.broadcast(sizes), held[part] == sizes["p"])
    # ids rise by one inside a range
    return both.withColumn(name, F.col(at) - F.col("first") + F.col("before")).select(*rows.columns, name)

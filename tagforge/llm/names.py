"""Column names of an operator's result that can't clash, and the split that learners share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def own_names(columns: Iterable[str], made: Iterable[str], hidden: Iterable[str] = ()) -> dict[str, str]:
    """Each input column and its name in the result: `in_` comes before one that the operator makes or uses, until it is free.

    Names count as equal whatever their case, as they do in Spark.
    """
    columns = list(columns)
    kept = {x.lower() for x in (*made, *hidden)}
    taken = kept | {c.lower() for c in columns}
    out = {}
    for c in columns:
        name = c
        if c.lower() in kept:
            while name.lower() in taken:
                name = f"in_{name}"
            taken.add(name.lower())
        out[c] = name
    return out


def held_out(doc_id: Column) -> Column:
    """Whether no model may learn from a row: its id's checksum is 2 modulo 4; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))

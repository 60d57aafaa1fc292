"""Rows left out before a join moves them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the table of keys, and those of one bitmap of it.
BITS, BITMAP = 1 << 23, 1 << 15


def only_listed(rows: DataFrame, listed: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """rows whose keys may be among those of listed: a join that follows moves few others.

    The keys of listed are hashed into a table of fixed size (1 MB at most), which is a constant of the plan, so wide
    rows are judged where they are read.  Rows without all keys go, as they do in an inner join.  A key that isn't listed
    passes only if it shares a bit with one that is; with a million listed keys about one in nine.  Keys are whole numbers or texts.
    """
    # as text, so that an int and a long of one value are one key
    place = F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(bits)) + 1
    marks = listed.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    found = {r.n: bytes(r.bitmap) for r in marks.collect()}  # bits / BITMAP rows at most
    table = F.array(*(F.lit(found.get(n + 1, b"")) for n in range(bits // BITMAP)))
    at = F.bitmap_bit_position(place)
    byte = F.substr(F.element_at(table, F.bitmap_bucket_number(place).cast("int")), (F.floor(at / 8) + 1).cast("int"), F.lit(1))
    number = F.conv(F.hex(byte), 16, 10).cast("int")
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return rows.where(whole & (F.length(byte) > 0) & (F.getbit(F.coalesce(number, F.lit(0)), (at % 8).cast("int")) == 1))

"""Rows numbered and written in order over many tasks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tagforge.operators import ordered, pipeline, records
from tagforge.plans import registry
from tagforge.sources import tables

SF = "/root/testdata/sf0.001"


def test_numbered(spark):
    """Ties, nulls, clashing names, skewed keys and an empty table; more than one range."""
    rows = [(i * 37 % 101, i, "x") for i in range(900)] + [(None, i, "y") for i in range(50)] + [(5, i, "z") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, n long, __part0 string").repartition(7)
    got = ordered.numbered(df, [F.col("k").desc_nulls_last(), F.col("n"), F.col("__part0")], parts=6)
    assert got.columns == ["k", "n", "__part0", "place"]
    listed = [(r.k, r.n, r["__part0"]) for r in sorted(got.collect(), key=lambda r: r.place)]
    assert listed == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1], r[2])) and {r.place for r in got.collect()} == set(range(len(rows)))
    assert ordered.numbered(df.limit(0), [F.col("k")]).count() == 0


def test_ordered_parts(spark, tmp_path):
    """Parts read one after the other are the rows in order; texts hold quotes and line ends; a part that is missing is noticed."""
    rows = registry.QUERIES["q17_record"](spark, SF).withColumn("tag_ord", F.pmod(F.xxhash64("raw_text"), F.lit(97))).withColumn("product_name", F.concat(F.col("product_name"), F.lit(' "a",\n b')))
    path = f"{tmp_path}/out"
    parts = tables.write_ordered(rows.repartition(6), [*pipeline.ORDER, "warped_image"], path, parts=5)
    want = [tuple(r) for r in rows.orderBy(*pipeline.ORDER, "warped_image").select(records.COLUMNS).collect()]
    assert len(parts) > 1 and sum(p["rows"] for p in parts) == len(want)
    assert json.loads((tmp_path / "out" / tables.MANIFEST).read_text()) == parts
    one_after_the_other = [tuple(r) for p in parts for r in tables.read_results(spark, f"{path}/{p['file']}").collect()]
    assert one_after_the_other == want
    got = tables.read_ordered(spark, path).orderBy("place")
    assert [tuple(r)[:-1] for r in got.collect()] == want and [r.place for r in got.collect()] == list(range(len(want)))
    (tmp_path / "out" / parts[-1]["file"]).unlink()
    with pytest.raises(ValueError, match="manifest"):
        tables.read_ordered(spark, path)

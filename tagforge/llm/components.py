"""Connected components by joins: alternating large-star and small-star rounds (Kiveris et al., 2014).

Rounds go on while there are more than `last` links; what is left then, or was no more from the start, is
a block of bounded size that one task finishes.  A round costs the driver a dozen stages of as many tasks as
there are partitions, whatever is in them, so small graphs take none.

Nothing of the graph reaches the driver but two sums a round.  A node with very many neighbours
is only ever reduced to its least one (combined before the shuffle) and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import ship_code, staged, unstage

#: Links that one task finishes: 2 MB of ids.
LAST_LINKS = 1 << 17


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links and the least one that it reaches."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = code[: len(a)], code[len(a) :]
    least = np.arange(len(nodes))
    while True:
        p, q = least[a], least[b]
        if np.array_equal(p, q):
            return nodes, nodes[least]
        np.minimum.at(least, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := least[least], least):
            least = up


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task with all links that are left."""
    table = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    nodes, least = least_nodes(table["a"].to_numpy(), table["b"].to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Large-star links every larger neighbour, small-star every smaller one and the node, to the least."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if larger_only else both.where("b < a")
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    kept = near.where("b > a") if larger_only else near
    moved = kept.join(least, "a").select(F.col("b").alias("x"), "m")
    if not larger_only:
        moved = moved.unionByName(least.select(F.col("a").alias("x"), "m"))
    return moved.where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", last: int = LAST_LINKS) -> DataFrame:
    """node, component (its least node) for every node of an edge; loops are allowed, nulls are not."""
    ship_code(edges.sparkSession)
    links = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    links = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc")
    sign = _sign(links)
    while sign[0] > last:
        before, links = links, staged(_star(_star(links, True), False), "cc")
        unstage(before)
        sign, old = _sign(links), sign
        if sign == old:
            return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    return staged(links.coalesce(1).mapInArrow(finished, "node long, component long"), "cc-nodes")

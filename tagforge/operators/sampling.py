"""Ordered sampling of a video's frames by their last kept one, in many tasks a video.

Each frame's successor, should it be kept, is fixed: the first later frame whose signal differs enough.  So:

1. Frames are sorted over all tasks and packed into blocks with their least and greatest signal and their records
   (frames that are higher or lower than all before them in the block).
2. A block finds its frames' successors inside by binary lifting over window extremes; for the others the block that holds the
   successor follows from all blocks' extremes in the same way, and its place there from that block's records.
3. A block is entered at records only.  Each entry becomes one pointer: how many frames are kept from there on in the
   block, and the entry that comes next.  Pointers are doubled by joins from the first frame on, so `most`
   frames take log2(most) rounds, however long the video is.
4. Blocks that are reached list their kept frames.

A task holds one block and a number of extremes that is a 65,536th of the video's frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagforge.sources.stage import ship_code, staged

#: Frames of a block.
BLOCK = 1 << 16


def first_outside(low: np.ndarray, high: np.ndarray, value: np.ndarray, change: float, start: np.ndarray) -> np.ndarray:
    """For each value the first place from start on where low is under value - change or high over value + change; len(low) if there is none."""
    n = len(low)
    pos, levels, width = start.copy(), [(low, high)], 1
    while 2 * width <= n:
        lo, hi = levels[-1]
        levels.append((np.minimum(lo[:-width], lo[width:]), np.maximum(hi[:-width], hi[width:])))
        width *= 2
    for lo, hi in reversed(levels):
        ok = pos + width <= n
        at = np.where(ok, pos, 0)
        ok &= ~(differs(value, lo[at], change) | differs(value, hi[at], change))
        pos = np.where(ok, pos + width, pos)
        width //= 2
    return pos


def differs(a: np.ndarray, b: np.ndarray, change: float) -> np.ndarray:
    return np.abs(b - a) > change


def records(signal: np.ndarray) -> np.ndarray:
    """Places that are higher or lower than all before them."""
    up, down = np.maximum.accumulate(signal), np.minimum.accumulate(signal)
    new = np.ones(len(signal), bool)
    new[1:] = (signal[1:] > up[:-1]) | (signal[1:] < down[:-1])
    return np.flatnonzero(new)


def packed_blocks(kind: pa.DataType, block: int):
    """video, frame_idx, signal in order -> video, at (in the order of blocks), ids, signal, low, high, place and level of records."""
    names = ["video", "at", "ids", "signal", "low", "high", "place", "level"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, video, ids, signal, begun = TaskContext.get().partitionId() << 33, None, [], [], False

        def row() -> pa.RecordBatch:
            nonlocal at, ids, signal
            i, s = np.concatenate(ids), np.concatenate(signal)
            r = records(s)
            columns = [pa.array([video], kind), [at], [i.tobytes()], [s.tobytes()], [float(s.min())], [float(s.max())], [r.astype("<i4").tobytes()], [s[r].tobytes()]]
            at, ids, signal = at + 1, [], []
            return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in columns], names=names)

        for batch in filter(len, batches):
            videos = batch.column(0).to_pylist()
            edges = [0, *(i for i in range(1, len(videos)) if videos[i] != videos[i - 1]), len(videos)]
            for a, z in zip(edges, edges[1:], strict=False):
                if begun and videos[a] != video and ids:
                    yield row()
                video, begun = videos[a], True
                while a < z:
                    some = min(z - a, block - sum(map(len, ids)))
                    ids.append(batch.column(1).slice(a, some).to_numpy().astype("<i8"))
                    signal.append(batch.column(2).slice(a, some).to_numpy().astype("<f8"))
                    a += some
                    if sum(map(len, ids)) == block:
                        yield row()
        if ids:
            yield row()

    return run


def numbers(value: bytes, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(value, kind)


def pointed(change: float):
    """key, at, signal, blocks (at, low, high of the video's) -> key, at, inside, targets, which: successors in the block, or the block they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, targets, which = [], [], []
            for at, raw, every in zip(*(batch.column(c).to_pylist() for c in ("at", "signal", "blocks")), strict=True):
                s = numbers(raw)
                n = len(s)
                own = first_outside(s, s, s, change, np.arange(1, n + 1))
                own[own >= n] = -1
                ats = np.array([b["at"] for b in every])
                low, high = (np.array([b[c] for b in every]) for c in ("low", "high"))
                far = np.flatnonzero(own < 0)
                block = first_outside(low, high, s[far], change, np.full(len(far), int(np.searchsorted(ats, at)) + 1))
                found = block < len(ats)
                several, of = np.unique(block[found], return_inverse=True)
                w = np.full(n, -1, "<i4")
                w[far[found]] = of
                inside.append(own.astype("<i4").tobytes())
                targets.append(ats[several].tolist())
                which.append(w.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), pa.array(inside, pa.binary()), pa.array(targets, pa.list_(pa.int64())), pa.array(which, pa.binary())], names=["key", "at", "inside", "targets", "which"])

    return run


def entered(change: float):
    """A block with what was pointed and the records of its targets -> key, at, entry, n, next_at, next_entry of its own entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("at", "signal", "place", "inside", "which", "targets", "others")
            for i, (at, raw, place, inside, which, targets, others) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                s, own, w = numbers(raw), numbers(inside, "<i4").tolist(), numbers(which, "<i4")
                there = {o["at"]: (numbers(o["place"], "<i4"), numbers(o["level"])) for o in others or []}
                last = [-1] * len(s)
                for t, target in enumerate(targets):
                    mine = np.flatnonzero(w == t)
                    p, level = there[target]
                    for m, j in zip(mine.tolist(), p[first_outside(level, level, s[mine], change, np.zeros(len(mine), int))].tolist(), strict=True):
                        last[m] = j
                n, leave = [1] * len(s), list(range(len(s)))
                for j in range(len(s) - 1, -1, -1):
                    if own[j] >= 0:
                        n[j], leave[j] = 1 + n[own[j]], leave[own[j]]
                entries = numbers(place, "<i4").tolist()
                ways = [leave[e] for e in entries]
                to = [targets[w[x]] if w[x] >= 0 else None for x in ways]
                columns = [batch.column("key").take(pa.array([i] * len(entries))), pa.array([at] * len(entries)), pa.array(entries, pa.int32()), pa.array([n[e] for e in entries], pa.int64()), pa.array(to, pa.int64()), pa.array([last[x] if t is not None else None for x, t in zip(ways, to, strict=True)], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "at", "entry", "n", "next_at", "next_entry"])

    return run


def listed(most: int):
    """Reached entries of blocks -> key, place in the order of kept frames, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (entry, before, ids, inside) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("entry", "before", "ids", "inside")), strict=True)):
                own, at, kept = numbers(inside, "<i4"), entry, []
                while at >= 0 and before + len(kept) < most:
                    kept.append(at)
                    at = int(own[at])
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array([i] * len(kept), pa.int64())), pa.array(np.arange(before, before + len(kept))), pa.array(numbers(ids, "<i8")[kept])], names=["key", "place", "id"])

    return run


def followed(pointers: DataFrame, first: DataFrame, most: int) -> DataFrame:
    """key, at, entry, before (frames kept before it) of all entries that are reached before most frames are kept."""
    reached = staged(first.withColumn("before", F.lit(0).cast("long")), "sample-reached")
    jump = pointers.where("next_at is not null")
    step = 1
    while step < most:
        jump = staged(jump, "sample-jump")
        if jump.isEmpty():
            break
        more = reached.join(jump, ["key", "at", "entry"]).select("key", F.col("next_at").alias("at"), F.col("next_entry").alias("entry"), (F.col("before") + F.col("n")).alias("before")).where(F.col("before") < most)
        reached = staged(reached.unionByName(more), "sample-reached")
        then = jump.select("key", F.col("at").alias("next_at"), F.col("entry").alias("next_entry"), F.col("n").alias("m"), F.col("next_at").alias("at2"), F.col("next_entry").alias("entry2"))
        jump = jump.join(then, ["key", "next_at", "next_entry"]).select("key", "at", "entry", (F.col("n") + F.col("m")).alias("n"), F.col("at2").alias("next_at"), F.col("entry2").alias("next_entry")).where(F.col("n") < most)
        step *= 2
    return reached


def sample_frames(frames: DataFrame, gate: float, change: float, most: int, block: int = BLOCK) -> DataFrame:
    """frames: video, frame_idx, sharpness, signal -> video, kept: ids of kept frames in order.

    A frame is kept if it is sharp enough and its signal differs by more than `change` from the last kept frame's; after
    `most` frames no more are.  Null and not-a-number signals, null numbers and frames are never kept; frames of one number are
    ordered by their signal; a null video is one more video; one without a sharp frame has no row.
    """
    ship_code(frames.sparkSession)
    kind = frames.schema["video"].dataType
    signal = F.col("signal").cast("double")
    sharp = frames.where((F.col("sharpness") >= gate) & F.col("frame_idx").isNotNull() & signal.isNotNull() & ~F.isnan(signal)).select("video", F.col("frame_idx").cast("long").alias("frame_idx"), signal.alias("signal"))
    order = ["video", "frame_idx", "signal"]
    schema = f"video {kind.simpleString()}, at long, ids binary, signal binary, low double, high double, place binary, level binary"
    packed = sharp.repartitionByRange("video", "frame_idx").sortWithinPartitions(*order).mapInArrow(packed_blocks(to_arrow_type(kind), block), schema)
    blocks = staged(packed.select(F.struct("video").alias("key"), "*").drop("video"), "sample-blocks")
    extremes = blocks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("blocks"))
    keyed = blocks.schema["key"].dataType.simpleString()
    made = staged(blocks.select("key", "at", "signal").join(extremes, "key").mapInArrow(pointed(change), f"key {keyed}, at long, inside binary, targets array<long>, which binary"), "sample-pointed")
    asked = made.select("key", F.col("at").alias("of"), F.explode("targets").alias("at"))
    others = asked.join(blocks.select("key", "at", "place", "level"), ["key", "at"]).groupBy("key", F.col("of").alias("at_of")).agg(F.collect_list(F.struct("at", "place", "level")).alias("others"))
    several = made.join(blocks.select("key", "at", "signal", "place"), ["key", "at"]).join(others.withColumnRenamed("at_of", "at"), ["key", "at"], "left")
    pointers = several.mapInArrow(entered(change), f"key {keyed}, at long, entry int, n long, next_at long, next_entry int")
    first = blocks.groupBy("key").agg(F.min("at").alias("at")).withColumn("entry", F.lit(0))
    reached = followed(pointers, first, most)
    kept = reached.join(blocks.select("key", "at", "ids"), ["key", "at"]).join(made.select("key", "at", "inside"), ["key", "at"]).mapInArrow(listed(most), f"key {keyed}, place long, id long")
    # `most` ids a video
    return kept.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("kept")).select("key.video", "kept")

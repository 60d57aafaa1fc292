"""Operators on detections: the best observation of each track, frames, sampling, progress.

Best observations are one aggregation with a full tie key, combined before the shuffle, so a track
with very many boxes costs no more than its partial results.  Sampling by a number is in `sampling`; sampling by
images decides by the last kept image, so a video's frames pass one task in order; they are sorted there, not
gathered, and only the last kept one is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tagforge.functions.geometry import frame_ms
from tagforge.functions.similarity import resized, windowed_similarity
from tagforge.sources.stage import staged

LEAST_CONF = 0.3


def track_best(boxes: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """boxes: track_id, frame_idx, box_idx, conf, sharpness -> one row a track, with the carried columns of its best box.

    The score is sharpness + 100 conf; on a tie the earliest frame, then box, wins.  Boxes without
    a track or under LEAST_CONF take no part; a null score loses against any other.
    """
    seen = boxes.where((F.col("conf") >= LEAST_CONF) & F.col("track_id").isNotNull()).withColumn("score", F.col("sharpness") + 100 * F.col("conf"))
    order = F.struct("score", (-F.col("frame_idx")).alias("f"), (-F.col("box_idx")).alias("b"))
    best = F.max_by(F.struct("frame_idx", "box_idx", "conf", "score", *carried), order)
    return seen.groupBy("track_id").agg(best.alias("best"), F.min(F.struct("frame_idx", "box_idx")).alias("first")).select("track_id", "best.*", F.col("first.frame_idx").alias("first_frame"), F.col("first.box_idx").alias("first_box"))


def frame_tracks(best: DataFrame, fps: float) -> DataFrame:
    """Tracks of each best frame in the order in which they were first seen, with the frame's milliseconds."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first_frame", "first_box", "track_id"))), lambda x: x["track_id"])
    return best.groupBy("frame_idx").agg(listed.alias("tracks")).withColumn("timestamp_ms", frame_ms(F.col("frame_idx"), F.lit(fps)))


def _in_video_order(frames: DataFrame, *columns) -> DataFrame:
    return frames.select("video", F.col("frame_idx").cast("long").alias("frame_idx"), *columns).repartition("video").sortWithinPartitions("video", "frame_idx")


def _kept_lists(schema, step):
    """step(state, batch of one video) for every part of a video in order -> video, kept (list of ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, kept, state, begun = None, [], None, False
        row = lambda: pa.RecordBatch.from_arrays([pa.array([video], schema), pa.array([kept], pa.list_(pa.int64()))], names=["video", "kept"])
        for batch in filter(len, batches):
            videos = batch.column(0).to_pylist()
            edges = [0, *(i for i in range(1, len(videos)) if videos[i] != videos[i - 1]), len(videos)]
            for a, z in zip(edges, edges[1:], strict=False):
                if not begun or videos[a] != video:
                    if begun:
                        yield row()
                    video, kept, state, begun = videos[a], [], None, True
                state = step(state, kept, batch.slice(a, z - a))
        if begun:
            yield row()

    return run


def sample_images(frames: DataFrame, gate: float = 100, most_similar: float = 0.95, most: int = 200) -> DataFrame:
    """frames: video, frame_idx, sharpness, rows, cols, grid (gray levels, row by row) -> video, kept.

    As `sampling.sample_frames`, but a frame is kept unless its windowed similarity to the last kept frame,
    resized if their sizes differ, exceeds `most_similar`.  Only the last kept frame is held.  A frame with a missing
    level is never kept and never compared with.  Whether two frames are similar needs both of them, so a video's sharp
    frames pass one task in order; videos are as many tasks as there are.
    """
    def step(last, kept, batch):
        for frame, rows, cols, grid in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            if len(kept) >= most:
                break
            image = np.array(grid, float).reshape(rows, cols)
            if last is None or windowed_similarity(image, last if last.shape == image.shape else resized(last, rows, cols)) <= most_similar:
                last = image
                kept.append(frame)
        return last

    sharp = frames.where((F.col("sharpness") >= gate) & (F.size("grid") == F.col("rows") * F.col("cols")) & (F.col("rows") > 0) & F.forall("grid", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))))
    return _sampled(_in_video_order(sharp, F.col("rows").cast("int"), F.col("cols").cast("int"), F.col("grid").cast("array<double>")), step)


def _sampled(ordered: DataFrame, step) -> DataFrame:
    kind = ordered.schema["video"].dataType
    schema = StructType([StructField("video", kind), StructField("kept", ArrayType(LongType()))])
    return ordered.mapInArrow(_kept_lists(to_arrow_type(kind), step), schema)


def monotone_progress(log: DataFrame, block: int = 1 << 16) -> DataFrame:
    """log: task_id, seq, fraction -> rows whose fraction is no less than all before it (and 0).

    Rows are sorted over all tasks and numbered in blocks of `block` rows, whatever their seq; maxima of a task's blocks
    run ahead of the rows of each block, so a log with very many rows is as many groups as it has blocks.
    """
    order = ["task_id", "seq"]
    rows = log.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    # ids rise from row to row in a partition and from one partition to the next, so equal quotients are neighbours
    rows = rows.withColumn("__block", F.floor(F.col("__at") / block))
    rows = staged(rows, "progress-rows")
    most = rows.groupBy("task_id", "__block").agg(F.max("fraction").alias("most"))
    earlier = Window.partitionBy("task_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    most = most.select(F.col("task_id").alias("__task"), F.col("__block").alias("__b"), F.max("most").over(earlier).alias("__before"))
    rows = rows.join(most, rows["task_id"].eqNullSafe(most["__task"]) & (rows["__block"] == most["__b"]))
    inside = Window.partitionBy("task_id", "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__most", F.greatest(F.lit(0.0), F.col("__before"), F.max("fraction").over(inside)))
    return rows.where(F.col("fraction") >= F.col("__most")).select(*log.columns)


def pick_payload(symbols, secondary):
    """The payload of the first QR symbol, else the second reader's, else ''."""
    first = F.get(F.filter(symbols, lambda s: s["type"] == "QRCODE"), 0)["data"]
    return F.coalesce(F.nullif(first, F.lit("")), secondary, F.lit(""))

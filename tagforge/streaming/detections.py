"""Detections as a stream of files: every micro-batch goes through the batch pipeline.

Best observations are kept per batch as mergeable partial results; `merged_best` reduces them
to one a track, so late batches and replays change nothing but what they should.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagforge.operators.tracks import track_best
from tagforge.sources.tables import DETECTIONS


def detection_stream(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    return spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def keyed(boxes: DataFrame) -> DataFrame:
    """Tracks are numbered within a video: the pair is the key."""
    return boxes.where("track_id is not null").withColumn("track_id", F.struct("video", "track_id"))


def start_best_tracks(boxes: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes each batch's best observations to out/batch=<id>; a replayed batch overwrites its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        track_best(keyed(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = boxes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merged_best(spark: SparkSession, out: str) -> DataFrame:
    parts = spark.read.parquet(out)
    order = F.struct("score", (-F.col("frame_idx")).alias("f"), (-F.col("box_idx")).alias("b"))
    best = F.max_by(F.struct("frame_idx", "box_idx", "conf", "score"), order)
    return parts.groupBy("track_id").agg(best.alias("best")).select("track_id.*", "best.*")

"""Best tracks and monotone progress as streams with one value of state a key, and a folder of uploads as a stream.

State is a value for each track or task, whatever has come before: the best box and the first one, or the greatest
share told.  It lies in RocksDB below the query's checkpoint, so a lost executor or a restart costs the batch that was under
way only.  Results are written as one part a batch, which a replayed batch overwrites; parts are folded into a snapshot every
`FOLDED` batches, so a reader never meets more than two snapshots' worth of parts.

Edge cases: boxes without a track or under the least confidence take no part; a null score loses against any other; a late
batch changes a track only if it holds a better or an earlier box; a progress row that comes late is judged by what has been
told by then; null fractions are never told, and a null key is a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tagforge.operators.tracks import LEAST_CONF
from tagforge.sources.stage import _hadoop, ship_code

#: Batches whose parts are folded into one snapshot.
FOLDED = 16
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UPLOAD = "path string, modificationTime timestamp, length long, content binary"
BEST = "video string, track_id long, frame_idx long, box_idx long, conf double, score double, first_frame long, first_box long"
_STATE = "frame_idx long, box_idx long, conf double, score double, first_frame long, first_box long"


class BestTrack(StatefulProcessor):
    """A track's best box so far and its first one."""

    def init(self, handle) -> None:
        self.best = handle.getValueState("best", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.best.get() if self.best.exists() else None
        now = tuple(held) if held is not None else None
        for part in rows:
            for frame, box, conf, score in zip(part.frame_idx.tolist(), part.box_idx.tolist(), part.conf.tolist(), part.score.tolist(), strict=True):
                score = None if score is None or score != score else score
                if now is None:
                    now = (frame, box, conf, score, frame, box)
                    continue
                first = min((now[4], now[5]), (frame, box))
                worth = lambda f, b, s: (s is not None, s or 0.0, -f, -b)
                best = (frame, box, conf, score) if worth(frame, box, score) > worth(now[0], now[1], now[3]) else now[:4]
                now = (*best, *first)
        if now is not None and now != (tuple(held) if held is not None else None):
            self.best.update(now)
            names = ["frame_idx", "box_idx", "conf", "score", "first_frame", "first_box"]
            yield pd.DataFrame({"video": [key[0]], "track_id": [key[1]]} | {n: [v] for n, v in zip(names, now, strict=True)})

    def close(self) -> None:
        pass


class Monotone(StatefulProcessor):
    """The greatest share that a task has told."""

    def init(self, handle) -> None:
        self.most = handle.getValueState("most", "fraction double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        most = self.most.get()[0] if self.most.exists() else 0.0
        part = pd.concat(list(rows)).sort_values("seq", kind="stable")  # one task's rows of one batch
        part = part[part.fraction.notna()]
        before = part.fraction.cummax().shift(fill_value=most).clip(lower=most)
        told = part[part.fraction >= before]
        if len(told):
            self.most.update((float(told.fraction.max()),))
            yield told.assign(task_id=key[0])[["task_id", "seq", "message", "fraction"]]

    def close(self) -> None:
        pass


def prepared(spark: SparkSession) -> None:
    ship_code(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def best_tracks(boxes: DataFrame) -> DataFrame:
    """A stream of boxes -> BEST, a row whenever a batch changes a track."""
    prepared(boxes.sparkSession)
    seen = boxes.where((F.col("conf") >= LEAST_CONF) & F.col("track_id").isNotNull())
    seen = seen.select("video", "track_id", "frame_idx", F.col("box_idx").cast("long").alias("box_idx"), "conf", (F.col("sharpness") + 100 * F.col("conf")).alias("score"))
    return seen.groupBy("video", "track_id").transformWithStateInPandas(BestTrack(), BEST, "Update", "None")


def monotone_progress(log: DataFrame) -> DataFrame:
    """A stream of task_id, seq, message, fraction -> the rows whose fraction is no less than all that the task has told."""
    prepared(log.sparkSession)
    rows = log.select("task_id", F.col("seq").cast("long").alias("seq"), "message", F.col("fraction").cast("double").alias("fraction"))
    return rows.groupBy("task_id").transformWithStateInPandas(Monotone(), "task_id string, seq long, message string, fraction double", "Append", "None")


def uploads(spark: SparkSession, folder: str, pattern: str = "*.y4m", contents: bool = False) -> DataFrame:
    """A stream of the files that land below a folder: path, modificationTime, length and, if asked for, content."""
    files = spark.readStream.format("binaryFile").schema(UPLOAD).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files if contents else files.drop("content")


def _folders(spark: SparkSession, out: str, kind: str) -> list[int]:
    """Numbers of the finished parts or snapshots."""
    p, fs = _hadoop(spark, out)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}=") and fs.exists(_hadoop(spark, f"{out}/{n}/_SUCCESS")[0]))


def current_best(spark: SparkSession, out: str) -> DataFrame:
    """BEST, one row a track: the newest snapshot and the parts after it."""
    snapshot = max(_folders(spark, out, "snapshot"), default=-1)
    paths = [f"{out}/snapshot={snapshot:09d}"] * (snapshot >= 0) + [f"{out}/part={n:09d}" for n in _folders(spark, out, "part") if n > snapshot]
    if not paths:
        return spark.createDataFrame([], BEST)
    rows = spark.read.schema(BEST).parquet(*paths)
    order = F.struct(F.col("score").isNotNull().alias("known"), "score", (-F.col("frame_idx")).alias("f"), (-F.col("box_idx")).alias("b"))
    best = F.max_by(F.struct("frame_idx", "box_idx", "conf", "score"), order)
    return rows.groupBy("video", "track_id").agg(best.alias("x"), F.min(F.struct("first_frame", "first_box")).alias("y")).select("video", "track_id", "x.*", "y.*")


def start_best_tracks(boxes: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps out up to date; `current_best` reads it at any time."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/part={number:09d}")
        if number % FOLDED == FOLDED - 1:
            current_best(spark, out).write.mode("overwrite").parquet(f"{out}/snapshot={number:09d}")
            # the snapshot before stays, with its parts, for those who are reading it
            snapshots = _folders(spark, out, "snapshot")
            kept = snapshots[-2] if len(snapshots) > 1 else -1
            for kind in ("part", "snapshot"):
                for n in _folders(spark, out, kind):
                    if n < kept or kind == "part" and n == kept:
                        p, fs = _hadoop(spark, f"{out}/{kind}={n:09d}")
                        fs.delete(p, True)

    writer = best_tracks(boxes).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

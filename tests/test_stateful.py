"""Streams with state against the batch operators: replays, late batches, restarts, bounded state and parts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tagforge.operators import tracks
from tagforge.sources import tables
from tagforge.streaming import detections, stateful


def boxes_of(seed, n):
    rng = random.Random(seed)
    box = lambda i: (rng.choice(["a", "b", None]), rng.randrange(40), i, rng.choice([None, 1, 2, 3]), rng.choice([0.2, 0.5, 0.9]), 0.0, 0.0, 1.0, 1.0, rng.choice([None, 1.0, 7.0, 7.0, 30.0]))
    return [box(i) for i in range(n)]


def best(rows):
    keyed = rows.where("track_id is not null").withColumn("track_id", F.struct("video", "track_id"))
    return {(r.track_id.video, r.track_id.track_id, r.frame_idx, r.box_idx, r.score, r.first_frame, r.first_box) for r in tracks.track_best(keyed).collect()}


def test_best_tracks(spark, tmp_path, monkeypatch):
    """Small files in many batches, a restart with late files that hold earlier and better boxes, a file that comes twice."""
    monkeypatch.setattr(stateful, "FOLDED", 2)
    rows = boxes_of(1, 240)
    out, checkpoint = f"file://{tmp_path}/out", f"{tmp_path}/check"
    late = [("a", 0, 500, 1, 0.9, 0.0, 0.0, 1.0, 1.0, 7.0), ("new", 3, 501, 9, 0.9, 0.0, 0.0, 1.0, 1.0, 1.0), *rows[:40]]
    for n, part in enumerate((rows[120:], rows[:120], late)):
        spark.createDataFrame(part, tables.DETECTIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = stateful.start_best_tracks(detections.detection_stream(spark, f"{tmp_path}/in", 1), out, checkpoint)
        assert query.awaitTermination(240) and query.exception() is None
        got = {(r.video, r.track_id, r.frame_idx, r.box_idx, r.score, r.first_frame, r.first_box) for r in stateful.current_best(spark, out).collect()}
        want = best(spark.read.parquet(f"{tmp_path}/in"))
        assert got == want
        assert sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]) <= len(want) + 1
    assert stateful.current_best(spark, f"file://{tmp_path}/none").count() == 0
    assert len(list((tmp_path / "out").glob("part=*"))) <= 2 * stateful.FOLDED


def test_monotone_progress(spark, tmp_path):
    """Batches in order give the batch result; a late row is judged by what was told."""
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), i, f"m{i}", rng.choice([None, round(rng.random(), 2)])) for i in range(60)]
    schema = "task_id string, seq long, message string, fraction double"
    held = []
    for part in (rows[:25], rows[25:], [("x", 0, "late", 0.0), ("x", 99, "end", 1.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/log")
        stream = stateful.monotone_progress(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/log"))
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/check").foreachBatch(lambda b, _: held.extend(map(tuple, b.collect()))).start().awaitTermination(240)
    want = tracks.monotone_progress(spark.createDataFrame(rows, schema)).collect()
    assert sorted(held, key=str) == sorted([*map(tuple, want), ("x", 99, "end", 1.0)], key=str)


def test_uploads(spark, tmp_path):
    (tmp_path / "in" / "task").mkdir(parents=True)
    (tmp_path / "in" / "task" / "a.y4m").write_bytes(b"12345")
    (tmp_path / "in" / "other.txt").write_bytes(b"x")
    held = []
    run = lambda df: df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda b, _: held.extend(b.collect())).start().awaitTermination(120)
    run(stateful.uploads(spark, f"{tmp_path}/in"))
    (tmp_path / "in" / "b.y4m").write_bytes(b"1")
    run(stateful.uploads(spark, f"{tmp_path}/in"))
    assert [(r.path.rpartition("/")[2], r.length) for r in held] == [("a.y4m", 5), ("b.y4m", 1)]
    assert "content" in stateful.uploads(spark, f"{tmp_path}/in", contents=True).columns

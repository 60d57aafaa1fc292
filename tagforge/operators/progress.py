"""Progress of real work: what is told follows from tasks and rows that have passed, never from plans.

A `Progress` runs each stage's action in a job group of its own and watches the group's tasks: the share
told rises from the stage's begin to its end with the share of finished tasks, and the end is told only
when the action has come back.  Shares that fall behind what was told are left out.  Everything told goes to a
log in the shared folder as well, one small file each, which `read_log` reads and `progress_json` formats.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
LOG = "task_id string, seq long, message string, fraction double"
#: Seconds between two looks at the tasks of a stage.
EVERY = 0.2


class Progress:
    """Tells (message, fraction) to `told` and, given a folder, writes the log of task_id there."""

    def __init__(self, spark: SparkSession, told: Callable[[str, float], None] | None = None, folder: str | None = None, task_id: str | None = None, every: float = EVERY) -> None:
        self.spark, self.told, self.folder, self.every = spark, told, folder, every
        self.task_id = task_id or uuid.uuid4().hex[:12]
        self._lock, self._most, self._seq = threading.Lock(), 0.0, 0

    def tell(self, message: str, fraction: float) -> bool:
        """False if more than that has been told already."""
        with self._lock:
            if fraction < self._most:
                return False
            self._most = fraction
            if self.told:
                self.told(message, fraction)
            if self.folder:
                self._write(message, fraction)
            self._seq += 1
            return True

    def _write(self, message: str, fraction: float) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder.rstrip('/')}/{self.task_id}-{self._seq:06d}.json")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write((json.dumps({"task_id": self.task_id, "seq": self._seq, "message": message, "fraction": fraction}) + "\n").encode())
        finally:
            out.close()

    def stage(self, message: str, begin: float, end: float, action: Callable[[], T]) -> T:
        """action(), whose jobs are watched; tells begin before it, shares while it runs, and end after it."""
        sc, group, over = self.spark.sparkContext, f"stage-{uuid.uuid4().hex}", threading.Event()
        self.tell(message, begin)

        def watch() -> None:
            tracker = sc.statusTracker()
            while not over.wait(self.every):
                seen = {i: s for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for i in job.stageIds if (s := tracker.getStageInfo(i))}
                total = sum(s.numTasks for s in seen.values())
                if total:
                    # what is left is not known, so the share nears the end and doesn't reach it
                    self.tell(message, begin + (end - begin) * 0.99 * sum(s.numCompletedTasks for s in seen.values()) / total)

        before = sc.getLocalProperty("spark.jobGroup.id"), sc.getLocalProperty("spark.job.description")
        sc.setJobGroup(group, message)
        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            out = action()
        finally:
            over.set()
            watcher.join()
            sc.setLocalProperty("spark.jobGroup.id", before[0])
            sc.setLocalProperty("spark.job.description", before[1])
        self.tell(message, end)
        return out


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that was told to a folder."""
    return spark.read.schema(LOG).json(folder)


def observed(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """rows with counts that are known, without a pass of their own, once an action has read them all."""
    seen = Observation(uuid.uuid4().hex)
    return rows.observe(seen, F.count("*").alias("rows"), *(c.alias(name) for name, c in counts.items())), seen

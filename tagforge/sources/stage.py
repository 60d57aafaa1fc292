"""Tables that cut lineage, written to the folder that the whole cluster shares, and code for its workers.

All of an application's tables lie in one folder, which is deleted when the application ends;
`unstage` deletes a table sooner, once a later one has taken its place.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs on one machine, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only if that is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{LOCAL_SHARED}/{os.getpid()}"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder, which goes when the application ends."""
    root = f"{shared_dir(spark)}/tagforge-{spark.sparkContext.applicationId}"
    p, fs = _hadoop(spark, root)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers as a zip file, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_tagforge_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    sc.addPyFile(target)
    sc._tagforge_shipped = True


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back; lost executors cost no recomputation before it."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    p, fs = _hadoop(df.sparkSession, df._staged)
    fs.delete(p, True)

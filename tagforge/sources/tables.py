"""Readers and writers: result tables as CSV and HTML, hand-made labels, image files, detections."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagforge.functions import text
from tagforge.operators.records import COLUMNS, LABELS, SHOWN, display
from tagforge.sources.stage import ship_code, staged

DETECTIONS = "video string, frame_idx long, box_idx int, track_id long, conf double, x1 float, y1 float, x2 float, y2 float, sharpness double"
NUMBERS = {"frame_timestamp": T.LongType(), "x_min": T.IntegerType(), "y_min": T.IntegerType(), "x_max": T.IntegerType(), "y_max": T.IntegerType()}
#: A fixed value: how the labels mark what is missing.
NONE = "нет"
#: A fixed value: how the labels spell one of their columns.
MISSPELT = "wholesale_level_1_coun"


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DETECTIONS).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The result CSV with its own types; a missing value is '' again, never null, in text columns."""
    return _texts(_result_rows(spark, path))


def _result_rows(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, NUMBERS.get(c, T.StringType())) for c in COLUMNS])
    return spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _texts(rows: DataFrame, *more) -> DataFrame:
    return rows.select(*(F.col(c) if c in NUMBERS else text.text_of(F.col(c)).alias(c) for c in COLUMNS), *more)


def write_results(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; quotes are doubled and missing values empty.  Files are as many as partitions, or one."""
    rows = rows.select(COLUMNS)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


MANIFEST = "_manifest.json"


def write_ordered(rows: DataFrame, order: list[str], path: str, parts: int | None = None) -> list[dict]:
    """Results as many CSV files whose rows follow each other: the files and their numbers of rows, in order, are returned and written to MANIFEST.

    rows have the result columns and those of order; Spark chooses the number of parts unless one is given.  Each file is one range of the order, so no task sorts or writes them all.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    write_results(ranged, path)
    # a part's name begins with the number of its range
    files = spark.read.text(path, pathGlobFilter="part-*").select(F.col("_metadata.file_name").alias("file")).distinct().collect()  # a row a file
    counted = {r.file: r.n for r in _result_rows(spark, path).select(F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count("*").alias("n")).collect()}
    made = [{"file": f, "rows": counted.get(f, 0)} for f in sorted(r.file for r in files)]
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(json.dumps(made).encode())
    finally:
        out.close()
    return made


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """Results written by `write_ordered` with place, the number of each row in their order; raises if the files aren't those of the manifest."""
    source = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    stream = source.getFileSystem(spark._jsc.hadoopConfiguration()).open(source)
    try:
        parts = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    rows = _result_rows(spark, path).withColumns({"__file": F.col("_metadata.file_name"), "__at": F.monotonically_increasing_id()})
    rows = staged(rows, "ordered")
    found = {r["__file"]: (r.n, r.first) for r in rows.groupBy("__file").agg(F.count("*").alias("n"), F.min("__at").alias("first")).collect()}
    if {f: n for f, (n, _) in found.items()} != {p["file"]: p["rows"] for p in parts if p["rows"]}:
        raise ValueError(f"the files in {path} aren't those of its manifest")
    begin, starts = 0, []
    for p in parts:
        if p["rows"]:
            starts.append((p["file"], begin - found[p["file"]][1]))
            begin += p["rows"]
    shift = spark.createDataFrame(starts, "__f string, __shift long")
    # a file is read by one task from its start to its end
    return _texts(rows.join(F.broadcast(shift), F.col("__file") == F.col("__f")), (F.col("__at") + F.col("__shift")).alias("place"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Hand-made labels: NONE is null, text is trimmed, decimal commas and points both read, the misspelt count column renamed."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True)
    clean = lambda c: F.nullif(F.nullif(text.strip(F.col(f"`{c}`")), F.lit(NONE)), F.lit(""))
    out = {MISSPELT: "wholesale_level_1_count"}
    number = lambda c: F.replace(clean(c), F.lit(","), F.lit("."))
    kinds = {c: "decimal(10,2)" for c in raw.columns if "price" in c} | {c: "double" for c in ("x_min", "y_min", "x_max", "y_max")} | {"frame_timestamp": "long"}
    cols = [(number(c).try_cast(kinds[c]) if c in kinds else F.regexp_extract(clean(c), r"-?\d+", 0).try_cast("int") if c == "discount_amount" else clean(c)).alias(out.get(c, c)) for c in raw.columns]
    return raw.select(*cols)


def read_images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """path, content of the image files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def write_images(files: DataFrame, folder: str) -> int:
    """files: path below the folder, content -> that many files, written by the tasks that hold them; a task that runs again writes the same."""
    spark = files.sparkSession
    ship_code(spark)
    uri = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri()
    if (uri.getScheme() or "file") == "file":
        return files.select("path", "content").mapInArrow(_written(uri.getPath()), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    return files.select("path", "content").mapInArrow(_written(base, system), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _written(base: str, system=None):
    def run(batches):
        import posixpath

        import pyarrow as pa
        from pyarrow import fs

        files, n = system or fs.LocalFileSystem(), 0
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target = posixpath.normpath(posixpath.join(base, path or ""))
                if not target.startswith(base.rstrip("/") + "/"):
                    raise ValueError(f"{path!r} lies outside of the folder")
                files.create_dir(posixpath.dirname(target), recursive=True)
                with files.open_output_stream(target) as out:
                    out.write(content)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return run


def html_rows(rows: DataFrame) -> DataFrame:
    """One HTML table row for each record; values are escaped, a thumbnail column becomes an image."""
    pictured = "thumbnail" in rows.columns
    shown = display(rows, *(["thumbnail"] if pictured else []))
    cells = F.concat(*(F.concat(F.lit("<td>"), text.escape_html(F.col(c)), F.lit("</td>")) for c in SHOWN))
    if pictured:
        image = F.when(text.text_of(F.col("thumbnail")) != "", F.concat(F.lit('<td><img src="'), text.escape_html(F.col("thumbnail")), F.lit('"></td>'))).otherwise("<td></td>")
        cells = F.concat(image, cells)
    return shown.select(F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("value"))


def html_page(rows: DataFrame) -> DataFrame:
    """The whole report as numbered lines: head, header row, one line a record in the order of rows, foot."""
    names = [*(["thumbnail"] if "thumbnail" in rows.columns else []), *SHOWN]
    header = "".join(f"<th>{LABELS[c]}</th>" for c in names)
    head = f'<html><head><meta charset="utf-8"></head><body><table><thead><tr>{header}</tr></thead><tbody>'
    line = lambda n, value: rows.sparkSession.range(1).select(F.lit(n).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(value).alias("value"))
    body = html_rows(rows).select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("place"), "value")
    return line(0, head).unionByName(body).unionByName(line(2, "</tbody></table></body></html>")).orderBy("part", "place")


def write_html_page(rows: DataFrame, path: str) -> None:
    """One text file that is the page; for a report that a person reads, so of few rows."""
    html_page(rows).select("value").coalesce(1).write.mode("overwrite").text(path)


def write_html_rows(rows: DataFrame, path: str) -> None:
    """Table rows as text files; a page includes them between its own head and foot."""
    html_rows(rows).write.mode("overwrite").text(path)


def progress_json(log: DataFrame) -> DataFrame:
    """task_id and a JSON message for each progress row."""
    return log.select("task_id", F.to_json(F.struct("message", F.col("fraction").alias("progress"))).alias("value"))

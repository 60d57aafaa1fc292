"""Token counts as delta-maintained rollups.

A batch of changes is signed: an insert adds a document's tokens to its group (source, language,
tokenizer version), a delete takes them away, a revised count is a delete of the old and an insert of
the new.  Each batch is summed to one row a group (combined before the shuffle) and added to the totals,
which are kept as a table of one row a group: reading them costs no more after many batches.

A commit writes the new totals to a folder of their own, then renames a file that names the folder and the
batch to the next version number.  Renaming fails if that number is taken, so of two writers one starts
again from the other's totals; a batch whose id is among those counted is skipped, and one that broke
off left no number and is not seen.  So replays, retries and concurrent writers count once.

Ids of counted batches are those of the version files; every `FOLDED` versions they go to a part of a
table of their own, so a commit writes one id and looks through `2 * FOLDED` files at most.  Folders of earlier
versions, and what broken commits have left, are deleted `KEEP` seconds after they were last of use; a
writer or reader that was slower than that and finds its version gone starts again from the newest.

Edge cases: null and empty texts count 0 tokens and 1 document; repeated rows count each; null
sources and languages are groups of their own; groups whose documents and tokens sum to nothing are
left out; an empty batch commits with no rows; other columns are ignored.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, pre_tokens, ranks_path
from .staging import read_table, ship_code, staged, staging_path, unstage
from .wordhash import pieces

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
VERSION = "byte_bpe_50k@1"
ESTIMATE = "utf8_bytes/4@1"
#: Versions whose batch ids go to one part of the table of ids, and the seconds for which unused folders stay.
FOLDED, KEEP = 64, 3600.0
#: Distinct words of which a task remembers the number of tokens.
REMEMBER = 1_000_000


def count_tokens(ranks):
    """Last column: tokens of the first, each distinct word of the task encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_ranks, known = encoder(ranks.value), {}
        for batch in pieces(batches):
            data, at, doc = pre_tokens(batch.column(0))
            raw, n = data.tobytes(), np.zeros(len(at), np.int64)
            if len(known) > REMEMBER:
                known = {}
            for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                w = raw[a:z]
                c = known.get(w)
                if c is None:
                    c = known[w] = len(by_ranks._encode_single_piece(w))
                n[i + 1] = c
            total = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(total[doc[1:]] - total[doc[:-1]])], names=[*batch.schema.names[1:], "n_tokens"])

    return run


def counted(docs: DataFrame, ranks_file: str, version: str = VERSION) -> DataFrame:
    """source, lang, tokenizer, n_tokens of every row."""
    spark = docs.sparkSession
    ship_code(spark)
    with open(ranks_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(count_tokens(ranks), "source string, lang string, n_tokens long").withColumn("tokenizer", F.lit(version))


def estimated(docs: DataFrame, version: str = ESTIMATE) -> DataFrame:
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("tokenizer"), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).cast("long").alias("n_tokens"))


def inserts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sign", F.lit(1))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sign", F.lit(-1))


def gone(error: Exception) -> bool:
    """Whether a read failed because its files aren't there any more."""
    said = str(error)
    return any(x in said for x in ("PATH_NOT_FOUND", "FileNotFoundException", "FAILED_READ_FILE.FILE_NOT_EXIST", "does not exist"))


class Rollup:
    """Totals in a folder of the cluster's shared storage; unused folders stay for `keep` seconds."""

    def __init__(self, spark: SparkSession, path: str, keep: float = KEEP) -> None:
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _at(self, name: str = ""):
        return self._fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, name: str = "") -> dict[str, float]:
        """Names in a folder and the time of each one's last change in seconds."""
        fs, at = self._files(), self._at(name)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(at)} if fs.exists(at) else {}

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in self._listed("log") if n.isdigit())

    def _entry(self, version: int) -> tuple[str, str]:
        """Folder and batch of a version."""
        stream = self._files().open(self._at(f"log/{version:012d}"))
        try:
            folder, batch = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n", 1)
        finally:
            stream.close()
        return folder, batch

    def _publish(self, version: int, folder: str, batch: str) -> bool:
        """Gives the folder that version's number; False if another writer has it."""
        fs = self._files()
        fs.mkdirs(self._at("log"))
        new, final = self._at(f"log/new-{uuid.uuid4().hex}"), self._at(f"log/{version:012d}")
        out = fs.create(new, True)
        out.write(f"{folder}\n{batch}".encode())
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            self._fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, final, none)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            fs.delete(new, False)
            return False
        return True

    def _parts(self) -> list[int]:
        """The last version whose id is in each part of the table of ids; parts without a marker were never finished."""
        return sorted(int(n) for n in self._listed("batches") if n.isdigit() and self._files().exists(self._at(f"batches/{n}/_SUCCESS")))

    def _is_counted(self, batch: str, versions: list[int]) -> bool:
        parts = self._parts()
        if any(self._entry(v)[1] == batch for v in versions if not parts or v > parts[-1]):
            return True
        ids = [f"{self.path}/batches/{p:012d}" for p in parts]
        return bool(ids) and self.spark.read.schema("batch string").parquet(*ids).where(F.col("batch") == batch).limit(1).count() > 0

    def _totals(self, versions: list[int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self._entry(versions[-1])[0]}/totals")

    def committed(self) -> list[str]:
        """Ids of the batches that are counted."""
        parts, versions = self._parts(), self._versions()
        found = {self._entry(v)[1] for v in versions if not parts or v > parts[-1]}
        if parts:
            found |= {r.batch for r in self.spark.read.schema("batch string").parquet(*(f"{self.path}/batches/{p:012d}" for p in parts)).collect()}
        return sorted(found)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """changes: KEYS, n_tokens, sign.  False if the batch had been committed before."""
        delta, missed = None, None
        while True:
            versions = self._versions()
            try:
                if self._is_counted(batch, versions):
                    break
                totals = self._totals(versions)
            except Exception as error:  # another writer has folded or swept these files
                missed = self._overtaken(error, versions, missed)
                continue
            if delta is None:
                delta = staged(changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens")), "op8-delta")
            new = f"{self.path}/v-{uuid.uuid4().hex}"
            summed = totals.unionByName(delta).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
            try:
                summed.write.parquet(f"{new}/totals")
            except Exception as error:
                self._files().delete(self._at(new.removeprefix(f"{self.path}/")), True)
                missed = self._overtaken(error, versions, missed)
                continue
            number = versions[-1] + 1 if versions else 1
            if self._publish(number, new, batch):
                unstage(delta)
                self._fold(number)
                self._sweep()
                return True
            self._files().delete(self._at(new.removeprefix(f"{self.path}/")), True)
        if delta is not None:
            unstage(delta)
        return False

    def _overtaken(self, error: Exception, versions: list[int], missed: list[int] | None) -> list[int]:
        """The versions, if reading them failed because files were gone and they weren't tried before; else raises."""
        if not gone(error) or versions == missed:
            raise error
        return versions

    def _fold(self, version: int) -> None:
        """Puts the ids of FOLDED versions into a part of their own; a part that is half written is written again."""
        if version % FOLDED:
            return
        last = max(self._parts(), default=0)
        ids = [(self._entry(v)[1],) for v in self._versions() if last < v <= version]
        self.spark.createDataFrame(ids, "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batches/{version:012d}")

    def _sweep(self) -> None:
        """Deletes what no reader can need: old versions, folded version files, leftovers of broken commits."""
        fs, now, log = self._files(), time.time(), self._listed("log")
        versions, folded = sorted(int(n) for n in log if n.isdigit()), max(self._parts(), default=0)
        used = {self._entry(versions[-1])[0]} if versions else set()
        for v, after in zip(versions, versions[1:], strict=False):
            folder, since = self._entry(v)[0], log[f"{after:012d}"]
            if now - since <= self.keep:
                used.add(folder)
            elif v <= folded:
                fs.delete(self._at(f"log/{v:012d}"), False)
        names = {f.rpartition("/")[2] for f in used}
        for name, since in self._listed().items():
            if name.startswith("v-") and name not in names and now - since > self.keep:
                fs.delete(self._at(name), True)
        for name, since in log.items():
            if name.startswith("new-") and now - since > self.keep:
                fs.delete(self._at(f"log/{name}"), False)

    def totals(self) -> DataFrame:
        """KEYS, n_docs, n_tokens of the newest version: one row a group."""
        missed = None
        while True:
            versions = self._versions()
            try:
                return self._totals(versions)
            except Exception as error:
                missed = self._overtaken(error, versions, missed)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table: estimates first, then every count revised by the tokenizer, the revision sent twice."""
    docs = read_table(spark, sf_dir, "documents")
    rollup = Rollup(spark, staging_path(spark, "op8"))
    rollup.commit("0001-estimates", inserts(estimated(docs)))
    revised = deletes(estimated(docs)).unionByName(inserts(counted(docs, ranks_path())))
    for _ in range(2):
        rollup.commit("0002-tokenized", revised)
    return rollup.totals()

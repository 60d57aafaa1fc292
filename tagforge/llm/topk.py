"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are turned by a rotation that a bounded sample suggests (its principal axes first; scores
don't change).  At each level of `LEVELS` the leading components are segments of their own and the
rest is a few longer ones; every segment keeps its mean and deviation.  With |q|^2 and |x|^2 known,
they bound the distance from below by sum n ((mq - mx)^2 + (sq - sx)^2), which is the same as
bounding the inner product from above by sum n (mq mx + sq sx).  Bounds go coarse to fine, each
level adding to the one before; a pair survives while its bound reaches the query's k-th best score
so far, and only survivors are scored, in whole numbers.  The threshold starts from the exact scores
against the sample.

Queries are a stated share of the rows, so blocks of queries against blocks of all rows are the
job itself.  A block of candidates holds `BLOCK` rows and meets `QUERY_BLOCK` queries at once, so
vectors (two bytes a component where that is enough) are shuffled once for so many queries; a task
holds no more than two blocks and gives k rows a query, which a last ranking merges.

Edge cases: vectors that are null, empty, hold null or non-finite components or one of which
floor(256 x) is no long take no part, as do rows with a null vec_id; a query only meets vectors of
its own length and never its own row; rows that repeat a vec_id are queries and candidates each for
itself; scores are exact, one beyond a long counts as the nearest long; ties go to the smaller
vec_id; fewer candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .staging import read_table, ship_code, staged, unstage
from .wordhash import utf8

#: Share of components that are segments of their own at each level, and segments of the rest.
LEVELS, REST = (0.0, 0.25, 0.5, 0.75, 0.875), 4
SCALE = 256
#: Margin of the bounds over the rounding of sums.
SLACK = 16
BLOCK, QUERY_BLOCK = 1 << 16, 1 << 14
#: Rows and queries whose bounds are held at once.
STEP_ROWS, STEP_QUERIES = 4096, 512
#: Rows of the sample that gives the first thresholds and the rotation; longer vectors aren't turned.
SAMPLE_ROWS, MOST_TURNED = 4096, 1024
#: Distinct vector lengths up to which their block counts are broadcast.
MAX_LENGTHS = 10_000
LONG = 2**63
VECTOR = "row long, vec_id long, dim int, value binary"


def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, vec_id, dim, value: the whole components as little-endian bytes, each as wide as the batch needs."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        long = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(long)
        flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
        with np.errstate(invalid="ignore"):
            bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < LONG))])
        ok = (long > 0) & (bad[end] == bad[end - long]) & ids.is_valid().to_numpy(zero_copy_only=False)
        for dim in np.unique(long[ok]).tolist():
            which = np.flatnonzero(ok & (long == dim))
            x = flat[(end - long)[which][:, None] + np.arange(dim)].astype(np.int64)
            kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or (np.abs(x) <= np.iinfo(k).max).all())
            data = np.ascontiguousarray(x.astype(kind))
            at = np.arange(len(x) + 1, dtype=np.int64) * dim * data.itemsize
            value = pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(x))), ids.take(pa.array(which)), pa.array(np.full(len(x), dim, np.int32)), value], names=["row", "vec_id", "dim", "value"])
            row += len(x)


def matrix(values, dim: int) -> np.ndarray:
    """The vectors of one length as rows of 64-bit numbers."""
    data, at = utf8(values)
    out = np.zeros((len(values), dim), np.int64)
    for kind in ("<i2", "<i4", "<i8"):
        size = np.dtype(kind).itemsize * dim
        which = np.flatnonzero(np.diff(at) == size)
        if len(which):
            out[which] = data[at[which][:, None] + np.arange(size)].reshape(-1).view(kind).reshape(-1, dim)
    return out


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of the products of two equally long sets of vectors, row by row; Python's numbers where 64 bits don't do."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if q.min(initial=0) != -LONG and x.min(initial=0) != -LONG and most < LONG:
        return (q * x).sum(axis=1)
    return np.array([min(max(v, -LONG), LONG - 1) for v in (q.astype(object) * x.astype(object)).sum(axis=1)], np.int64)


class Turned:
    """Vectors after the rotation with what the bounds need: leading components and, for each level, the rest's statistics."""

    def __init__(self, x: np.ndarray, rotation: np.ndarray | None) -> None:
        self.x = x.astype(np.float64) if rotation is None else x.astype(np.float64) @ rotation
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.upto = sorted({int(share * x.shape[1]) for share in LEVELS})
        self.rest = [self.statistics(self.x[:, n:]) for n in self.upto]

    @staticmethod
    def statistics(x: np.ndarray) -> np.ndarray:
        """Mean and deviation of each segment, weighted by the root of its length, side by side."""
        cuts = np.unique(np.linspace(0, x.shape[1], min(REST, x.shape[1]) + 1).astype(int))
        long = np.diff(cuts)
        mean = np.add.reduceat(x, cuts[:-1], axis=1) / long
        off = x - np.repeat(mean, long, axis=1)  # E[x^2] - mean^2 would cancel where components are nearly equal
        var = np.add.reduceat(off * off, cuts[:-1], axis=1) / long
        return np.concatenate([mean, np.sqrt(var)], 1) * np.sqrt(np.concatenate([long, long]))


def survivors(q: Turned, x: Turned, a: slice, b: slice, least: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) of two slices whose bound reaches the query's threshold at every level.

    Rotation, sums and statistics each err by about dimension * 2**-52 of the norms at most; SLACK is the margin.
    """
    rows, cols = np.arange(a.start, a.stop), np.arange(b.start, b.stop)
    error = SLACK * (q.x.shape[1] + 8) * 2.0**-52
    least = least - error * (q.norm[a] * x.norm[b].max(initial=0) + np.abs(np.where(np.isfinite(least), least, 0))) - 1
    known, done = np.zeros((len(rows), len(cols))), 0
    for level, n in enumerate(q.upto):
        known += q.x[rows, done:n] @ x.x[cols, done:n].T
        done = n
        alive &= known + q.rest[level][rows] @ x.rest[level][cols].T >= least[:, None]
        r, c = alive.any(axis=1), alive.any(axis=0)
        if not (r.all() and c.all()):
            rows, cols, least, alive, known = rows[r], cols[c], least[r], alive[r][:, c], known[r][:, c]
    i, j = np.nonzero(alive)
    return rows[i], cols[j]


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: greatest score, then least id."""
    order = np.argsort(ids, kind="stable")
    order = order[np.argsort(~score[order], kind="stable")]  # ~s is -s - 1, which fits
    order = order[np.argsort(query[order], kind="stable")]
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[rank < k]


def search_block(q_rows, q, least, rows, ids, x, k: int, rotation=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query number, candidate number and score of each query's k best, and how many pairs were scored exactly."""
    turned_q, turned_x = Turned(q, rotation), Turned(x, rotation)
    found, scored = [], 0
    for a in range(0, len(q), STEP_QUERIES):
        own = slice(a, min(a + STEP_QUERIES, len(q)))
        limit = np.array([-np.inf if v is None or v == -LONG else float(v) for v in least[own]])
        query, cand, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in range(0, len(x), STEP_ROWS):
            part = slice(b, min(b + STEP_ROWS, len(x)))
            i, j = survivors(turned_q, turned_x, own, part, limit, q_rows[own][:, None] != rows[part][None, :])
            scored += len(i)
            new = [exact(q[i[n : n + 65536]], x[j[n : n + 65536]]) for n in range(0, len(i), 65536)]
            query, cand, score = np.append(query, i), np.append(cand, j), np.concatenate([score, *new])
            best = best_of(query, ids[cand], score, k)
            query, cand, score = query[best], cand[best], score[best]
            full = np.flatnonzero(np.bincount(query - a, minlength=own.stop - a) == k)
            last = np.searchsorted(query, full + a, "right") - 1
            limit[full] = np.maximum(limit[full], np.where(score[last] == -LONG, -np.inf, score[last].astype(float)))
        found.append((query, cand, score))
    return *(np.concatenate([f[n] for f in found]) for n in range(3)), scored


def search(held, k: int):
    def run(asked: pa.Table, vectors: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "vec_id", "score"]
        if not asked.num_rows or not vectors.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        dim = asked["dim"][0].as_py()
        number = lambda t, c: t[c].to_numpy().astype(np.int64)
        q_rows, q_ids, ids = number(asked, "row"), number(asked, "vec_id"), number(vectors, "vec_id")
        query, cand, score, _ = search_block(q_rows, matrix(asked["value"], dim), asked["least"].to_pylist(), number(vectors, "row"), ids, matrix(vectors["value"], dim), k, held.value.rotation(dim))
        return pa.table(dict(zip(names, (q_rows[query], q_ids[query], ids[cand], score), strict=True)))

    return run


class Sample:
    """Vectors of a bounded sample by length."""

    def __init__(self, table: pa.Table) -> None:
        self.of = {}
        for dim in table["dim"].unique().to_pylist():
            own = table.filter(pc.equal(table["dim"], dim))
            self.of[dim] = own["row"].to_numpy(), matrix(own["value"], dim)

    def rotation(self, dim: int) -> np.ndarray | None:
        """The principal axes of the sample, strongest first."""
        x = self.of.get(dim, (None, np.zeros((0, dim))))[1].astype(np.float64)
        if dim > MOST_TURNED or len(x) < 2 * dim:
            return None
        x = x / max(np.abs(x).max(), 1)
        return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()

    def threshold(self, row: int, q: np.ndarray, k: int) -> int | None:
        """The k-th best score of a query against the sample."""
        rows, x = self.of.get(len(q), (np.zeros(0, np.int64), np.zeros((0, len(q)), np.int64)))
        x = x[rows != row]
        if len(x) < k:
            return None
        return int(np.sort(exact(np.broadcast_to(q, x.shape), x))[-k])


def with_threshold(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, rows = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            least: list[int | None] = [None] * batch.num_rows
            for dim in np.unique(dims).tolist():
                which = np.flatnonzero(dims == dim)
                for i, q in zip(which.tolist(), matrix(batch.column(3).take(pa.array(which)), dim), strict=True):
                    least[i] = held.value.threshold(int(rows[i]), q, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=[*batch.schema.names, "least"])

    return run


def dealt(table: DataFrame, block: str, n: str) -> DataFrame:
    """Rows dealt into n blocks by their row number."""
    return table.withColumn(block, F.pmod(F.xxhash64("row"), F.col(n)).cast("int"))


def top_k(table: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that is_query holds for, against all rows."""
    spark = table.sparkSession
    ship_code(spark)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = staged(rows.mapInArrow(integers, VECTOR), "op3-vectors")
    sizes = staged(vectors.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query(F.col("vec_id"))).alias("n_asked")), "op3-sizes")
    total, lengths = sizes.agg(F.sum("n"), F.count("*")).first()
    share = min(1.0, SAMPLE_ROWS / max(total or 0, 1))
    held = spark.sparkContext.broadcast(Sample(vectors.where(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000)).toArrow()))
    asked = staged(vectors.where(is_query(F.col("vec_id"))).mapInArrow(with_threshold(held, k), f"{VECTOR}, least long"), "op3-queries")
    # small tables are cut finer, so that all cores have a block
    least = F.least(F.lit(spark.sparkContext.defaultParallelism), F.ceil(F.col("n") / STEP_ROWS))
    plan = sizes.where("n_asked > 0").select("dim", F.greatest(F.ceil(F.col("n") / BLOCK), least).cast("int").alias("nx"), F.ceil(F.col("n_asked") / QUERY_BLOCK).cast("int").alias("nq"))
    plan = F.broadcast(plan) if lengths <= MAX_LENGTHS else plan
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = dealt(asked.join(plan, "dim"), "q_block", "nq").withColumn("block", each("nx")).drop("nx", "nq")
    others = dealt(vectors.join(plan, "dim"), "block", "nx").withColumn("q_block", each("nq")).drop("nx", "nq")
    keys = ["dim", "q_block", "block"]
    found = queries.groupBy(keys).cogroup(others.groupBy(keys)).applyInArrow(search(held, k), "query_row long, query_id long, vec_id long, score long")
    found = staged(found, "op3-found")
    for used in (vectors, sizes, asked):
        unstage(used)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole embeddings table; queries are the rows whose vec_id is divisible by 50."""
    return top_k(read_table(spark, sf_dir, "embeddings"), lambda v: v % 50 == 0)


ORACLE_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.r <> x.r AND len(q.e) = len(x.e))
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""

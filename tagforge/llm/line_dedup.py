"""Line dedup with two Bloom filters.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends with A-Z lower-cased, and is
known by a 128-bit digest.  Each task sets the bits of its documents' keys in a once-seen filter
and, for keys met again, in a twice-seen filter.  Filters are merged segment by segment, first in
groups of tasks and then over the groups (bits that two tasks both have are twice seen), so the
merged twice-seen filter holds every repeated key and a few that only look so.  Only keys it holds
are shuffled, for exact confirmation and for the smallest doc_id.

The filters have a bounded size: about `BITS_PER_LINE` bits a line, `MAX_BITS` at most (64 MB to
broadcast).  Beyond 33 million lines they fill up, so more keys are suspected and shuffled (a fifth
of the single ones at 150 million lines, nearly all at a billion, 24 bytes each); results stay exact.

Edge cases: a null or empty text is one empty line; keys under `MIN_CHARS` code points stay;
repeats inside the first document holding a key stay; a null doc_id counts as the largest id;
rows that repeat a doc_id are one document holding all their lines; other columns pass through,
renamed to in_<name> (once more if that is taken) where they clash with a column made here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import own_names
from .staging import read_table, ship_code, staged, unstage
from .wordhash import pieces

MIN_CHARS = 10
BITS_PER_LINE = 16
MAX_BITS = 1 << 29
#: Bits of one segment of the filters: what one merging row holds.
SEGMENT_BITS = 1 << 16
#: Tasks whose filters are merged first.
TASKS_MERGED = 256
#: Share of rows in which lines are counted, for the size of the filters only.
COUNTED = 0.02
SPACE = b" \t\n\x0b\x0c\r"
NO_ID = 2**63 - 1
MARKS = "segment int, part int, twice boolean, bits binary"
MADE = ("doc_id", "n_lines", "n_dropped", "kept_text")


def digests(lines: list[bytes], least: int) -> list[bytes | None]:
    """The digest of each lower-cased line's key; None if the key is shorter than `least` code points."""
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip(SPACE) if len(line) >= least else b""
        n = len(key)
        if n < least or (n < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least):
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def _keys(text: bytes | None, least: int) -> set[bytes]:
    """Distinct digests of a text (bytes.lower folds A-Z only)."""
    found = set(digests(text.lower().split(b"\n"), least)) if text else set()
    found.discard(None)
    return found


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def _places(keys: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit numbers of each digest."""
    both = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2) & np.uint64(bits - 1)
    return both[:, 0].astype(np.int64), both[:, 1].astype(np.int64)


def _held(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def _add(once: np.ndarray, twice: np.ndarray, keys: list[bytes], bits: int) -> None:
    """Keys of several documents, each document's once."""
    a, b = _places(keys, bits)
    _, first, count = np.unique(np.frombuffer(b"".join(keys), np.uint64)[::2], return_index=True, return_counts=True)
    again = _held(once, a) & _held(once, b)
    again[first[count > 1]] = True
    for bitmap, at in ((twice, a[again]), (twice, b[again]), (once, a), (once, b)):
        _set(bitmap, at)


def packed(bitmap: np.ndarray) -> bytes:
    """One segment as offsets of its bits or, if that is shorter, as it is."""
    at = np.flatnonzero(np.unpackbits(bitmap, bitorder="little")).astype("<u2").tobytes()
    return at if len(at) < len(bitmap) else bitmap.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if len(raw) == SEGMENT_BITS // 8:
        return np.frombuffer(raw, np.uint8)
    out = np.zeros(SEGMENT_BITS // 8, np.uint8)
    _set(out, np.frombuffer(raw, "<u2").astype(np.int64))
    return out


def local_filters(bits: int, least: int):
    """Per task and segment: the bits of both filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in pieces(batches):
            keys = [k for t in _texts(batch.column(0)) for k in _keys(t, least)]
            if keys:
                _add(once, twice, keys, bits)
        part, size = TaskContext.get().partitionId() // TASKS_MERGED, SEGMENT_BITS // 8
        for again, held in ((True, twice), (False, once)):
            full = np.flatnonzero(held.reshape(-1, size).any(axis=1))
            for begin in range(0, len(full), 64):
                found = full[begin : begin + 64]
                raw = [packed(held[i * size : (i + 1) * size]) for i in found.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.full(len(found), part, np.int32)), pa.array([again] * len(found)), pa.array(raw, pa.binary())], names=["segment", "part", "twice", "bits"])

    return run


def merge_segment(table: pa.Table) -> pa.Table:
    """One segment of several tasks or groups: bits that any has seen twice or two have seen, and bits seen."""
    size = SEGMENT_BITS // 8
    once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
    for again, raw in zip(table["twice"].to_pylist(), table["bits"].to_pylist(), strict=True):
        own = unpacked(raw)
        if again:
            twice |= own
        else:
            twice |= once & own
            once |= own
    first = lambda c: pa.chunked_array([table[c].combine_chunks().take(pa.array([0, 0]))])
    return pa.table({"segment": first("segment"), "part": first("part"), "twice": [True, False], "bits": pa.array([packed(twice), packed(once)], pa.binary())})


def suspected(held, bits: int, least: int):
    """doc, row, key: digests of each row's distinct keys that the twice-seen filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(held.value, np.uint8)
        for batch in pieces(batches):
            own = [list(_keys(t, least)) for t in _texts(batch.column(2))]
            keys = [k for ks in own for k in ks]
            if not keys:
                continue
            a, b = _places(keys, bits)
            ok = np.flatnonzero(_held(twice, a) & _held(twice, b))
            of = pa.array(np.repeat(np.arange(len(own)), [len(ks) for ks in own])[ok])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array([keys[i] for i in ok.tolist()], pa.binary())], names=["doc", "row", "key"])

    return run


def drop_lines(least: int):
    """Rows text, keys, doc_id and others, without the lines whose digests are among keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                text = text or b""
                n, left = text.count(b"\n") + 1, text
                if gone:
                    gone, own = set(gone), text.split(b"\n")
                    own = [x for x, k in zip(own, digests(text.lower().split(b"\n"), least), strict=True) if k not in gone]
                    left = b"\n".join(own)
                    n_dropped.append(n - len(own))
                else:
                    n_dropped.append(0)
                n_lines.append(n)
                kept.append(left)
            made = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(2), *made, *batch.columns[3:]], names=[*MADE, *batch.schema.names[3:]])

    return run


def _keyed(docs: DataFrame, *more) -> DataFrame:
    """__doc, __row (a hash of the text), __text and more columns: rows of one id, or of none, are told apart."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__doc"), F.xxhash64(text).alias("__row"), text.alias("__text"), *more)


def filter_bits(texts: DataFrame) -> int:
    """A power of two: the size of the filters for the column `text`."""
    n_bytes, lines = F.octet_length("text") + 1, F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    counted = texts.withColumn("counted", F.rand(7) < COUNTED)
    total, seen, some = counted.agg(F.sum(n_bytes), F.sum(F.when(F.col("counted"), lines)), F.sum(F.when(F.col("counted"), n_bytes))).first()
    lines = (total or 0) * ((seen or 0) + 1) / ((some or 0) + 64)
    return 1 << max(SEGMENT_BITS.bit_length() - 1, min(MAX_BITS.bit_length() - 1, int(lines * BITS_PER_LINE).bit_length()))


def twice_seen(texts: DataFrame, bits: int, least: int) -> bytes:
    """The merged twice-seen filter of the column `text`."""
    marks = texts.mapInArrow(local_filters(bits, least), MARKS)
    merged = marks.groupBy("segment", "part").applyInArrow(merge_segment, MARKS).groupBy("segment").applyInArrow(merge_segment, MARKS)
    twice = bytearray(bits // 8)
    for row in merged.where("twice").select("segment", "bits").toLocalIterator():  # bounded by MAX_BITS
        twice[row.segment * SEGMENT_BITS // 8 : (row.segment + 1) * SEGMENT_BITS // 8] = unpacked(row.bits).tobytes()
    return bytes(twice)


def repeated_lines(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """__doc, __row, __keys: the digests of the lines that each row loses."""
    spark = docs.sparkSession
    ship_code(spark)
    rows = _keyed(docs)
    texts = rows.select(F.col("__text").alias("text"))
    bits = filter_bits(texts)
    held = spark.sparkContext.broadcast(twice_seen(texts, bits, least))
    found = rows.select(F.col("__doc").alias("doc"), F.col("__row").alias("row"), F.col("__text").alias("text")).mapInArrow(suspected(held, bits, least), "doc long, row long, key binary")
    keys = staged(found, "op7-keys")
    first = keys.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("key", "first")
    first = staged(first, "op7-first")  # joined from an exchange of its own, so that a hot line can be split
    gone = keys.join(first, "key").where("doc > first").groupBy("doc", "row").agg(F.collect_set("key").alias("keys"))
    gone = staged(gone.toDF("__doc", "__row", "__keys"), "op7-gone")  # the same for a hot text
    unstage(keys)
    unstage(first)
    return gone


def line_dedup(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text and the other input columns."""
    gone = repeated_lines(docs, least)
    names = own_names((c for c in docs.columns if c not in ("doc_id", "text")), MADE, ("text", "__doc", "__row", "__text", "__keys"))
    rest = [F.col(f"`{c}`").alias(name) for c, name in names.items()]
    joined = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), *rest).join(gone, ["__doc", "__row"], "left")
    own = [c for c in joined.columns if c not in ("__doc", "__row", "__text", "__keys", "doc_id")]
    joined = joined.select("__text", "__keys", "doc_id", *(F.col(f"`{c}`") for c in own))
    schema = "doc_id long, n_lines long, n_dropped long, kept_text string" + "".join(f", `{c}` {joined.schema[c].dataType.simpleString()}" for c in own)
    return joined.mapInArrow(drop_lines(least), schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table; keys of ten code points or more."""
    out = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))

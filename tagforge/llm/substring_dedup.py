"""Substring dedup on a sparse De Bruijn graph of token k-mers.

* Rows that lie together are dealt into chunks of about `CHUNK_BYTES` of text, written once,
  compressed and bucketed by chunk.  What is found about a chunk's documents comes back to it by
  chunk and row number, so texts are never shuffled.
* Edges: k-mers of `K` words.  Of every window of `window` words the k-mer of least hash is an
  edge (all of them on a tie), so two documents that share a window share its edge, and only
  about one word in twenty is shuffled.  Each edge carries the hash of the words up to the next
  edge of its document and back to the last one (its links).
* Compaction: one aggregation by hash (combined before the shuffle) gives the repeated edges, the
  first document of each and its place there.  A link is nonbranching if all occurrences of its
  edges have the same one.  Repeated edges that follow each other in their first document over
  nonbranching links are one path; the table of paths is joined back to the edges of all documents,
  whose occurrences of a path then are one row each.
* Source coordinates: a span of a path is verified by a 96-bit hash of its words in the document
  against those at its place in the path's first document.  Windows with a repeated edge that lie in
  no path are verified one by one in the same way.

Exact copies (equal word sequences) of an earlier document skip the graph: all of it repeats.
Hot groups: every aggregation is a min / max or a count, combined on the map side; what goes back to
the occurrences is joined from a written table, so that AQE can split a hot edge, window or copy.

Edge cases: null and empty texts have no words; documents shorter than the window lose nothing;
a null doc_id counts as the largest id; rows that repeat a doc_id are judged each by its own
words and never against each other; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import chunks_written, read_table, ship_code, staged, unstage
from .wordhash import U64, mix, pieces, signed, sliding_min, split_words, window_hashes, window_starts

K = 12
WINDOW = 50
CHUNK_BYTES = 8 << 20
NO_ID = 2**63 - 1
TEXTS = "chunk long, i int, doc long, doc_id long, text string, seq long, seq2 long, n_words long"
EDGES = "chunk long, i int, doc long, at int, no int, edge long, next int, prev int"
SPANS = "chunk long, i int, doc long, at int, len int, w1 long, w2 int, late boolean"


def _edges(words, window: int) -> dict:
    """Edges of every document of a batch in order: word index, document, number in it, k-mer hash, links."""
    at, doc = window_starts(words.offsets, window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return {"at": none, "doc": none, "no": none, "hash": np.zeros(0, U64), "next": np.zeros(0, U64), "prev": np.zeros(0, U64), "window_at": at, "window_doc": doc, "window_min": np.zeros(0, U64)}
    kmer = window_hashes(words.hashes, K)
    least = sliding_min(kmer, window - K + 1)[at]
    chosen = np.zeros(len(kmer), bool)
    for shift in range(window - K + 1):
        chosen[at[kmer[at + shift] == least] + shift] = True
    pos = np.flatnonzero(chosen)
    of = np.searchsorted(words.offsets, pos, "right") - 1
    total = np.zeros(len(words.hashes) + 1, U64)
    np.cumsum(mix(words.hashes ^ U64(0xA5A5A5A5A5A5A5A5)) * _power(len(words.hashes)), out=total[1:])
    same = of[1:] == of[:-1]
    link = mix((total[pos[1:] + K] - total[pos[:-1]]) * _power(len(words.hashes), True)[pos[:-1]] + (pos[1:] - pos[:-1]).astype(U64)) | U64(1)
    link = np.where(same, link, U64(0))
    ahead, back = np.append(link, U64(0)), np.insert(link, 0, U64(0))
    no = np.arange(len(pos)) - np.searchsorted(of, of)
    return {"at": pos, "doc": of, "no": no, "hash": kmer[pos], "next": ahead, "prev": back, "window_at": at, "window_doc": doc, "window_min": least}


_ODD = 0x2545F4914F6CDD1D


def _power(n: int, inverse: bool = False) -> np.ndarray:
    out = np.full(n, pow(_ODD, -1, 1 << 64) if inverse else _ODD, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _sequence_hash(words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's whole word sequence."""
    out = []
    for seed in (0, 1):
        value = mix(words.hashes ^ U64(0x1234567 + seed)) * _power(len(words.hashes))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(value, dtype=U64)])
        back = np.append(_power(len(words.hashes), True), U64(1))
        out.append(mix((total[words.offsets[1:]] - total[words.offsets[:-1]]) * back[words.offsets[:-1]] + words.counts.astype(U64) * U64(0x9E3779B97F4A7C15)))
    return out[0], out[1]


def deal(most: int):
    """Rows with the number of their chunk, their number in it, and two hashes of their whole word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, n = TaskContext.get().partitionId() << 32, 0, 0
        for batch in pieces(batches):
            words = split_words(batch.column(1))
            if n and size + len(words.data) > most:
                chunk, size, n = chunk + 1, 0, 0
            a, b = _sequence_hash(words)
            rows = batch.num_rows
            made = [pa.array(np.full(rows, chunk)), pa.array(np.arange(n, n + rows, dtype=np.int32)), batch.column(0).fill_null(NO_ID), *batch.columns, pa.array(signed(a)), pa.array(signed(b)), pa.array(words.counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(made, names=["chunk", "i", "doc", "doc_id", "text", "seq", "seq2", "n_words"])
            size, n = size + len(words.data) + 16 * rows, n + rows

    return run


def _table(schema: str, parts: list[dict]) -> pa.Table:
    """Columns of the named kinds from parts of them."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]
    return pa.table({name: pa.chunked_array([pa.array(p[name]).cast(kind) for p in parts], kind) for name, kind in fields})


def _top(x: np.ndarray) -> np.ndarray:
    return (x >> U64(32)).astype(np.uint32).view(np.int32)


def edges_of(window: int):
    """A chunk's edges, without those of the rows that are copies of an earlier document."""

    def run(texts: pa.Table, copies: pa.Table) -> pa.Table:
        out = []
        own = texts.filter(pa.array(~np.isin(texts["i"].to_numpy(), copies["i"].to_numpy())))
        for batch in pieces(own.select(["chunk", "i", "doc", "text"]).to_batches()):
            words = split_words(batch.column(3))
            e, base = _edges(words, window), words.offsets[:-1]
            of = e["doc"]
            chunk, i, doc = (batch.column(n).to_numpy()[of] for n in range(3))
            out.append({"chunk": chunk, "i": i, "doc": doc, "at": e["at"] - base[of], "no": e["no"], "edge": signed(e["hash"]), "next": _top(e["next"]), "prev": _top(e["prev"])})
        return _table(EDGES, out)

    return run


def paths_of(edges: DataFrame) -> DataFrame:
    """edge, path (its first edge), place in it, n_edges and the first document of all repeated edges."""
    stats = edges.groupBy("edge").agg(F.min(F.struct("doc", "chunk", "i", "no")).alias("source"), F.max("doc").alias("last"), F.min("next").alias("n0"), F.max("next").alias("n1"), F.min("prev").alias("p0"), F.max("prev").alias("p1"))
    repeated = stats.where("source.doc < last").select("edge", "source.*", F.expr("n0 = n1 and n0 <> 0").alias("ahead"), F.expr("p0 = p1 and p0 <> 0").alias("back"))
    row = Window.partitionBy("chunk", "i").orderBy("no")
    goes_on = F.coalesce((F.lag("no").over(row) + 1 == F.col("no")) & F.lag("ahead").over(row) & F.col("back"), F.lit(False))
    cut = repeated.withColumn("first_no", F.max(F.when(~goes_on, F.col("no"))).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    path = Window.partitionBy("chunk", "i", "first_no")
    return cut.select("edge", F.min(F.when(F.col("no") == F.col("first_no"), F.col("edge"))).over(path).alias("path"), (F.col("no") - F.col("first_no")).alias("place"), F.count("*").over(path).cast("int").alias("n_edges"), F.col("doc").alias("source"))


def path_spans(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """chunk, i, a, z (first and last edge's word), source, complete: every document's occurrences of paths."""
    own = edges.select("chunk", "i", "at", "no", "edge").join(paths, "edge").withColumn("anchor", F.col("no") - F.col("place"))
    found = own.groupBy("chunk", "i", "path", "anchor").agg(F.min("at").alias("a"), F.max("at").alias("z"), F.first("source").alias("source"), (F.count("*") == F.first("n_edges")).alias("complete"))
    return found.select("chunk", "i", "a", "z", "source", "complete")


def _ranges(begin: np.ndarray, long: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each length, one after the other."""
    end = np.cumsum(long)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - long - begin, long)


def _span_hash(words, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the words begin to end of each span."""
    back, out = np.append(_power(len(words.hashes), True), U64(1))[begin], []
    for seed in (0x0DDBA11, 0xFACADE):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(words.hashes ^ U64(seed)) * _power(len(words.hashes)), dtype=U64)])
        out.append(mix((total[end] - total[begin]) * back + (end - begin).astype(U64) * U64(0x9E3779B97F4A7C15)))
    return out[0], out[1]


def windows_of(window: int):
    """Of a chunk's documents with occurrences of paths: spans of paths (len > 0) and other windows to verify (len 0)."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("i")
        of_row, a, z, source, complete = (found[c].to_numpy() for c in ("i", "a", "z", "source", "complete"))
        out = []
        has = texts.filter(pa.array(np.isin(texts["i"].to_numpy(), of_row)))
        for batch in pieces(has.select(["chunk", "i", "doc", "text"]).to_batches()):
            chunk, i, doc = (batch.column(n).to_numpy() for n in range(3))
            words = split_words(batch.column(3))
            e, base = _edges(words, window), words.offsets[:-1]
            first = np.searchsorted(of_row, i)
            n = np.searchsorted(of_row, i, "right") - first
            which, row = _ranges(first, n), np.repeat(np.arange(len(i)), n)
            begin, last = base[row] + a[which], base[row] + z[which]
            # the repeated edges: those that the spans cover, each with its first document
            low = np.searchsorted(e["at"], begin)
            long = np.searchsorted(e["at"], last, "right") - low
            repeated, where = np.unique(e["hash"][_ranges(low, long)], return_index=True)
            first_doc = np.repeat(source[which], long)[where]
            runs = last + K - window + 1 - begin
            whole = complete[which].astype(bool) & (runs > 0)
            change = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(change, begin[whole], 1)
            np.add.at(change, begin[whole] + runs[whole], -1)
            inside = np.cumsum(change) > 0
            place = np.minimum(np.searchsorted(repeated, e["window_min"]), max(len(repeated) - 1, 0))
            alone = np.flatnonzero((repeated[place] == e["window_min"]) & ~inside[e["window_at"]]) if len(repeated) else np.zeros(0, np.int64)
            at, d = e["window_at"][alone], e["window_doc"][alone]
            w1 = window_hashes(words.hashes, window)[at]
            w2 = window_hashes(mix(words.hashes ^ U64(0xC0FFEE)), window, 0x9E3779B97F4A7C15)[at]
            out.append({"chunk": chunk[d], "i": i[d], "doc": doc[d], "at": at - base[d], "len": np.zeros(len(at), np.int32), "w1": signed(w1), "w2": _top(w2), "late": first_doc[place[alone]] < doc[d]})
            d, b = row[whole], begin[whole]
            w1, w2 = _span_hash(words, b, last[whole] + K)
            out.append({"chunk": chunk[d], "i": i[d], "doc": doc[d], "at": b - base[d], "len": runs[whole], "w1": signed(w1), "w2": _top(w2), "late": source[which][whole] < doc[d]})
        return _table(SPANS, out)

    return run


def kept_of(window: int):
    """A chunk's rows without the words that its marks cover: windows at `at` and len - 1 more, or all (at -1)."""

    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        marks = marks.sort_by("i")
        of_row, at, long = (marks[c].to_numpy() for c in ("i", "at", "len"))
        out = []
        for batch in pieces(texts.select(["i", "doc_id", "text"]).to_batches()):
            i = batch.column(0).to_numpy()
            low, high = np.searchsorted(of_row, i).tolist(), np.searchsorted(of_row, i, "right").tolist()
            n_words, n_removed, kept = [], [], []
            for text, a, z in zip(batch.column(2).cast(pa.binary()).to_pylist(), low, high, strict=True):
                words = (text or b"").split()
                left = words
                if z > a:
                    change = np.zeros(len(words) + 1, np.int64)
                    copied = at[a:z].min() < 0
                    begin = np.zeros(1, np.int64) if copied else at[a:z].astype(np.int64)
                    end = np.array([len(words)]) if copied else begin + np.maximum(long[a:z], 1) + window - 1
                    np.add.at(change, begin, 1)
                    np.add.at(change, np.minimum(end, len(words)), -1)
                    left = [w for w, n in zip(words, np.cumsum(change).tolist(), strict=False) if not n]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            out.append(pa.table([batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"]))
        return pa.concat_tables(out)

    return run


def by_chunk(texts: DataFrame, found: DataFrame, step, schema: str) -> DataFrame:
    """step(a chunk's rows, what was found about them): texts stay where they are."""
    return texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(step, schema)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: words without those covered by a window of an earlier document."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    texts = chunks_written(rows.mapInArrow(deal(CHUNK_BYTES), TEXTS), "chunk", total, "op1_texts")

    first = texts.where(F.col("n_words") >= window).groupBy("seq", "seq2").agg(F.min("doc").alias("source"), F.max("doc").alias("last")).where("source < last")
    first = staged(first, "op1-first")
    copies = staged(texts.select("chunk", "i", "doc", "seq", "seq2").join(first, ["seq", "seq2"]).where("source < doc").select("chunk", "i"), "op1-copies")

    edges = staged(by_chunk(texts.select("chunk", "i", "doc", "text"), copies, edges_of(window), EDGES), "op1-edges")
    paths = staged(paths_of(edges), "op1-paths")
    found = staged(path_spans(edges, paths), "op1-spans")
    for used in (first, edges, paths):
        unstage(used)
    windows = staged(by_chunk(texts.select("chunk", "i", "doc", "text"), found, windows_of(window), SPANS), "op1-windows")
    sources = staged(windows.groupBy("w1", "w2").agg(F.min("doc").alias("source"), F.max("doc").alias("last")).where("source < last").select("w1", "w2", "source"), "op1-sources")
    late = windows.where("late").join(sources, ["w1", "w2"]).where("source < doc").select("chunk", "i", "at", "len")
    marks = staged(late.unionByName(copies.select("chunk", "i", F.lit(-1).alias("at"), F.lit(0).alias("len"))), "op1-marks")
    for used in (found, windows, sources, copies):
        unstage(used)
    return by_chunk(texts.select("chunk", "i", "doc_id", "text"), marks, kept_of(window), "doc_id long, n_words long, n_removed long, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table with windows of 50 words; the digest comes from the kept text."""
    out = substring_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))

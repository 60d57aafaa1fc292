"""Byte-level BPE encoding and decoding around one global shuffle of distinct words.

* Pre-tokens: the pattern of the tokenizer as boundaries between code point classes, found for a
  whole batch at once, so each is a byte span at a position of its document.
* The words that a bounded sample of the texts (`SAMPLE_BYTES`) holds most often, `FREQUENT` at
  most, are encoded once and broadcast.  The sample decides only which words need no shuffle.
* Rows that lie together are dealt into chunks of about `CHUNK_BYTES` of text, whatever they hold
  (so copies and nulls fill many chunks), and written once, compressed and bucketed by chunk, with
  the chunk's other distinct words.  Those words are shuffled by word with their chunk and number;
  each is encoded once, where its rows lie together, and its ids go back packed, by chunk and number.
* Chunks meet their ids without a shuffle of texts, and every document is reassembled by position.
  A word is in at most one row of a chunk, so a hot word is as many short rows as there are chunks.
* Decoding joins ids with the token-byte table (bounded by the vocabulary).

Frequent words are looked up by a 64-bit hash and compared byte by byte; the others by their bytes.

Edge cases: a null or empty text has no ids; no special tokens; repeated rows and ids are encoded
row by row; other columns pass through.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .names import own_names
from .staging import chunks_written, read_table, ship_code
from .wordhash import CHUNK_BYTES as PIECE_BYTES
from .wordhash import U64, _by_place, mix, pieces, utf8

#: Most words that are broadcast, and the bytes of text they are chosen from.
FREQUENT = 1 << 18
SAMPLE_BYTES = 64 << 20
#: Bytes of text (or one longer row) that are handled with the words of their own.
CHUNK_BYTES = 8 << 20
#: Words whose ids a task holds to pack them by chunk.
PACKED_WORDS = 500_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# Code points of Unicode's White_Space.
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_CLASSES: list[np.ndarray] = []
_ENCODERS: dict = {}
_BYTES: dict = {}


def classes() -> np.ndarray:
    if not _CLASSES:
        table = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode()[::2], np.uint8)
        out = np.where(table == ord("L"), LETTER, np.where(table == ord("N"), NUMBER, OTHER)).astype(np.uint8)
        out[WHITE_SPACE] = SPACE
        _CLASSES.append(out)
    return _CLASSES[0]


def pre_tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, byte offsets of all pre-tokens (they cover the text), and each document's first one."""
    data, at = utf8(texts)
    if not len(data):
        return data, np.zeros(1, np.int64), np.zeros(len(at), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    doc = np.searchsorted(lead, at)
    n = len(points)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[doc] = True
    run = np.empty(n + 1, bool)
    run[0] = run[n] = True
    run[1:n] = kind[1:] != kind[:-1]
    run |= edge
    blank = kind == SPACE
    start = run[:n].copy()
    # a space goes with what follows it; of a longer gap only the last character stands apart
    start[:-1] |= blank[:-1] & ~blank[1:] & ~edge[1:n]
    prefixed = np.zeros(n, bool)
    prefixed[1:] = (points[:-1] == 0x20) & ~edge[1:n] & ~blank[1:]
    start &= ~prefixed
    # 's 't 'm 'd 're 've 'll
    quote = np.flatnonzero((points == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~edge[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        one = points[quote + 1]
        two = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        quote, size = quote[short | long], np.where(short, 1, 2)[short | long]
        start[quote + 1] = False
        after = quote + 1 + size
        after = after[(after < n) & ~edge[np.minimum(after, n)]]
        start[after[kind[after] == LETTER]] = True
    first = np.flatnonzero(start)
    return data, np.append(lead[first], len(data)), np.searchsorted(first, doc)


def keys_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64-bit key of each span."""
    if len(at) < 2:
        return np.zeros(0, U64)
    long = np.diff(at)
    value = data.astype(U64)
    value += U64(1)
    value *= _by_place(int(long.max()))[np.arange(len(data)) - np.repeat(at[:-1], long)]
    return mix(np.add.reduceat(value, at[:-1]) + long.astype(U64) * U64(0x9E3779B97F4A7C15))


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def encoder(raw: bytes):
    import tiktoken

    if raw not in _ENCODERS:
        _ENCODERS[raw] = tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=read_ranks(raw), special_tokens={})
    return _ENCODERS[raw]


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans number `which` of flat, one after the other, and their offsets."""
    long = (at[1:] - at[:-1])[which]
    end = np.concatenate([np.zeros(1, np.int64), np.cumsum(long)])
    return flat[np.arange(end[-1]) - np.repeat(end[:-1] - at[which], long)], end


def _spans(data: np.ndarray, at: np.ndarray, which: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:z] for a, z in zip(at[which].tolist(), at[which + 1].tolist(), strict=True)]


def _packed(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All values one after the other, and their offsets."""
    at = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(x) for x in values], out=at[1:])
    return np.frombuffer(b"".join(values), np.uint8), at


class Frequent:
    """Words, their bytes and their ids in order of the words' keys."""

    def __init__(self, words: list[bytes], ids: list[list[int]]) -> None:
        data, at = _packed(words)
        key, order = np.unique(keys_of(data, at), return_index=True)  # of two words with one key one is left out
        self.key = key
        self.data, self.at = _gather(data, at, order)
        self.ids, self.ids_at = _packed([np.array(x, "<u4").tobytes() for x in ids])
        self.ids, self.ids_at = _gather(self.ids.view("<u4"), self.ids_at // 4, order)

    def find(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place of every span's word, or -1."""
        key = keys_of(data, at)
        if not len(self.key) or not len(key):
            return np.full(len(key), -1)
        where = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = np.flatnonzero((self.key[where] == key) & (np.diff(self.at)[where] == np.diff(at)))
        ours, cut = _gather(self.data, self.at, where[hit])
        theirs, _ = _gather(data, at, hit)
        wrong = np.unique(np.searchsorted(cut, np.flatnonzero(ours != theirs), "right") - 1)
        place = np.full(len(key), -1)
        place[hit] = where[hit]
        place[hit[wrong]] = -1
        return place


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n of every piece."""
    for batch in pieces(batches):
        data, at, _ = pre_tokens(batch.column(0))
        _, where, n = np.unique(keys_of(data, at), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(_spans(data, at, where), pa.binary()), pa.array(n)], names=["word", "n"])


def frequent_words(texts: DataFrame, total: int, by_ranks) -> Frequent:
    """The words that occur most often, twice at least, in a sample of the column `text`."""
    share = min(1.0, SAMPLE_BYTES / max(total, 1))
    sample = texts if share == 1 else texts.sample(False, share, 7)
    counts = sample.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    words = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").toArrow()["word"].to_pylist()
    return Frequent(words, [by_ranks._encode_single_piece(w) for w in words])


def deal(held, most: int):
    """Rows with __chunk, __words, __text first: a chunk's last row lists the words that aren't frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, chunk = held.value, TaskContext.get().partitionId() << 32
        rows: list[pa.RecordBatch] = []
        words: dict[bytes, None] = {}
        size = 0

        def whole() -> Iterator[pa.RecordBatch]:
            for i, b in enumerate(rows):
                listed = [None] * b.num_rows
                if i == len(rows) - 1:
                    listed[-1] = list(words)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, chunk)), pa.array(listed, pa.list_(pa.binary())), *b.columns], names=["__chunk", "__words", *b.schema.names])

        for batch in pieces(batches, "__text", min(most, PIECE_BYTES)):
            data, at, _ = pre_tokens(batch.column(0))
            if rows and size + len(data) > most:
                yield from whole()
                rows, words, size, chunk = [], {}, 0, chunk + 1
            rows.append(batch)
            size += len(data) + 16 * batch.num_rows
            words.update(dict.fromkeys(_spans(data, at, np.flatnonzero(frequent.find(data, at) < 0))))
        yield from whole()

    return run


def in_chunks(rows: DataFrame, held, total: int) -> DataFrame:
    """Rows dealt into chunks and written."""
    made = [StructField("__chunk", LongType()), StructField("__words", ArrayType(BinaryType()))]
    dealt = rows.mapInArrow(deal(held, CHUNK_BYTES), StructType([*made, *rows.schema.fields]))
    return chunks_written(dealt, "__chunk", total, "op6_chunks")


def encode_words(ranks, kind: str):
    """Rows chunk, no, word in order of the words: each word is encoded where it first comes; packed by chunk."""

    def packs(chunk: np.ndarray, no: np.ndarray, ids: list[bytes]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((no, chunk))
        flat, at = _packed(ids)
        edge = np.flatnonzero(np.diff(chunk[order], prepend=-1)).tolist()
        rows = [order[a:z] for a, z in zip(edge, [*edge[1:], len(order)], strict=True)]
        packed = lambda values: pa.array([v.tobytes() for v in values], pa.binary())
        n = (np.diff(at) // np.dtype(kind).itemsize).astype("<u4")
        yield pa.RecordBatch.from_arrays([pa.array(chunk[order[edge]]), packed(no[r].astype("<u4") for r in rows), packed(n[r] for r in rows), packed(_gather(flat, at, r)[0] for r in rows)], names=["__chunk", "no", "n", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_ranks, last, own = encoder(ranks.value), None, b""
        chunk, no, ids = [], [], []
        for batch in filter(len, batches):
            for w in batch.column(2).to_pylist():
                if w != last:
                    last, own = w, np.array(by_ranks._encode_single_piece(w), kind).tobytes()
                ids.append(own)
            chunk.append(batch.column(0).to_numpy())
            no.append(batch.column(1).to_numpy())
            if len(ids) >= PACKED_WORDS:
                yield from packs(np.concatenate(chunk), np.concatenate(no), ids)
                chunk, no, ids = [], [], []
        if ids:
            yield from packs(np.concatenate(chunk), np.concatenate(no), ids)

    return run


def encode_piece(texts, frequent: Frequent, words: dict[bytes, int], ids: np.ndarray, ids_at: np.ndarray) -> pa.Array:
    """Ids of each text, from the frequent words' and the chunk's own."""
    data, at, doc = pre_tokens(texts)
    place = frequent.find(data, at)
    other = np.flatnonzero(place < 0)
    place[other] = [len(frequent.key) + words[w] for w in _spans(data, at, other)]
    flat = np.concatenate([frequent.ids, ids])
    out, end = _gather(flat, np.concatenate([frequent.ids_at, ids_at[1:] + frequent.ids_at[-1]]), place)
    return _binary(out.view(np.uint8), end[doc] * 4)


def encode_chunk(held, kind: str, then=None):
    """One chunk's rows with the ids of its own words; `then` goes on with the encoded batches in the same worker."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        listed = texts["__words"].combine_chunks()
        own = {w: i for i, w in enumerate(listed.flatten().to_pylist())}
        no, n, ids = (np.frombuffer(b"".join(words[c].to_pylist()), k) for c, k in (("no", "<u4"), ("n", "<u4"), ("ids", kind)))
        order = np.argsort(no)
        if not np.array_equal(no[order], np.arange(len(own))):
            raise ValueError("a word of the chunk is missing")
        ids, ids_at = _gather(ids.astype("<u4"), np.concatenate([[0], np.cumsum(n.astype(np.int64))]), order)
        rows = texts.drop_columns(["__chunk", "__words"]).to_batches()
        out = (_with_ids(b, encode_piece(b.column(0), held.value, own, ids, ids_at)) for b in pieces(rows, "__text"))
        return pa.Table.from_batches(list(then(out) if then else out))

    return run


def _with_ids(batch: pa.RecordBatch, ids: pa.Array) -> pa.RecordBatch:
    n = np.diff(np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1]) // 4
    return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n.astype(np.int64)), ids], names=[*batch.schema.names[1:], "n_tokens", "ids"])


def encode(docs: DataFrame, ranks_file: str, decoded: bool = False) -> DataFrame:
    """Input columns but text, n_tokens and ids (little-endian unsigned 32-bit); `in_` comes before clashing names until they are free.

    With `decoded`, the ids are decoded again in the same pass into the column of that name.
    """
    spark = docs.sparkSession
    ship_code(spark)
    with open(ranks_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    made = ("n_tokens", "ids", "decoded") if decoded else ("n_tokens", "ids")
    text = F.col("text").cast("string")
    names = own_names((c for c in docs.columns if c != "text"), made, ("__text", "__chunk", "__words"))
    rows = docs.select(text.alias("__text"), *(F.col(f"`{c}`").alias(name) for c, name in names.items()))
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 16)).first()[0] or 0
    held = spark.sparkContext.broadcast(frequent_words(docs.select(text.alias("text")), total, encoder(ranks.value)))
    dealt = in_chunks(rows, held, total)
    words = dealt.where("__words is not null").select("__chunk", F.posexplode("__words").alias("no", "word"))
    kind = "<u2" if max(read_ranks(ranks.value).values(), default=0) < 1 << 16 else "<u4"
    ids = words.repartition("word").sortWithinPartitions("word").mapInArrow(encode_words(ranks, kind), "__chunk long, no binary, n binary, ids binary")
    fields = [f for f in rows.schema.fields if f.name != "__text"] + [StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    if decoded:
        fields.append(StructField("decoded", BinaryType()))
    step = encode_chunk(held, kind, decode_rows(ranks) if decoded else None)
    return dealt.groupBy("__chunk").cogroup(ids.groupBy("__chunk")).applyInArrow(step, StructType(fields))


def token_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens one after the other, and the offsets by id."""
    if raw not in _BYTES:
        of = {i: b for b, i in read_ranks(raw).items()}
        _BYTES[raw] = _packed([of.get(i, b"") for i in range(max(of) + 1)])
    return _BYTES[raw]


def decode_rows(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, at = token_bytes(ranks.value)
        for batch in pieces(batches, "ids"):
            raw, cut = utf8(batch.column(batch.schema.get_field_index("ids")))
            out, end = _gather(flat, at, raw.view("<u4").astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(out, end[cut // 4])], names=[*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, ranks_file: str) -> DataFrame:
    """All columns and decoded, the bytes that the column ids stands for."""
    spark = encoded.sparkSession
    ship_code(spark)
    with open(ranks_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    rows = encoded.select("ids", *(F.col(f"`{c}`") for c in encoded.columns if c not in ("ids", "decoded")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded binary"
    return rows.mapInArrow(decode_rows(ranks), schema)


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, encoded and decoded again."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, ranks_path(), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

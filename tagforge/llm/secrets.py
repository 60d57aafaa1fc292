"""Secret scans with corpus-wide ownership frequency.

One pass finds candidates in every whole text: the base kinds assign, access and hex, and wider
ones (`token`: 24 or more characters of a key alphabet with both cases and digits and at least
`MIN_BITS` bits of entropy a character, outside base spans; `pem`: a private key block's header,
whose value is the key's body, so that keys of one type are told apart).
Hashes of the candidates' values are then counted over the corpus by distinct documents
(repositories) and distinct sources (owners).  A value that `WIDE_OWNERS` owners or more hold, that
`WIDE_REPOSITORIES` documents or more hold whoever owns them, or that looks like a placeholder (not
asked of `pem`: encoded keys hold runs), is a copied example; one of few owners and few documents is
live-looking.  Base spans always stay; wider spans are reported only while live-looking.  Text is
never shuffled, only spans with hashes; distinct documents are counted first, combined before the
shuffle, and hot values meet in joins of written tables, which AQE can split.

Edge cases: a header without a body is a value of its document alone (of its text if doc_id is
null); a null or empty text has no spans; a null source is one owner of its own; equal spans of
different kinds are all kept; rows that repeat a doc_id are scanned row by row and count as one
document, rows without a doc_id as one each; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import read_table, ship_code, staged
from .wordhash import pieces

KINDS = ("assign", "access", "hex", "token", "pem")
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 25
MIN_BITS = 3.5
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
#: After a header: fields such as Proc-Type; then, where the footer is missing, the lines of base64. Line ends may be escaped.
FIELDS = re.compile(r"(?:(?:\s|\\[nr])*+[A-Za-z][A-Za-z-]*+:\x20*+[^\s\\]*+)*+")
LINES = re.compile(r"(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2}+)*+")
NOT_KEY = re.compile(r"\\[nr]|[^A-Za-z0-9+/=]")
EXAMPLE = re.compile(r"example|placeholder|changeme|your_|xxxx|(.)\1{7}", re.IGNORECASE)
SPANS = "array<struct<kind:int,start:int,end:int,value:long,example:boolean>>"


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """kind, start, end, secret value of the base kinds."""
    out = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]


def key_body(text: str, at: int) -> str:
    """The base64 characters of the private key whose header ends at `at`."""
    at = FIELDS.match(text, at).end()
    end = text.find("-----", at)
    if end < 0 or not text.startswith("-----END ", end):
        end = LINES.match(text, at).end()
    return NOT_KEY.sub("", text[at:end])


def wider_spans(text: str, base: list[tuple[int, int, int, str]], doc: int | None = None) -> list[tuple[int, int, int, str]]:
    out = []
    # starts of the base spans, and how far they and all before them reach
    starts = sorted(a for _, a, _, _ in base)
    ends = list(accumulate((z for _, _, z, _ in sorted(base, key=lambda x: x[1])), max))
    for m in TOKEN.finditer(text):
        x = m[0]
        before = bisect_left(starts, m.end())
        if before and ends[before - 1] > m.start():
            continue
        if any(map(str.isdigit, x)) and x.lower() != x and x.upper() != x and entropy(x) >= MIN_BITS:
            out.append((3, m.start(), m.end(), x))
    if "-----BEGIN " in text:
        out += [(4, m.start(), m.end(), key_body(text, m.end()) or f"{m[0]} {text if doc is None else doc}") for m in PEM.finditer(text)]
    return out


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row (its number), doc_id, source, spans."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("example", pa.bool_())]))
    row = TaskContext.get().partitionId() << 40
    for batch in pieces(batches):
        spans = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            base = base_spans(text or "")
            found = sorted(base + wider_spans(text or "", base, doc), key=lambda x: (x[1], x[0]))
            spans.append([{"kind": k, "start": a, "end": z, "value": int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True), "example": k != 4 and bool(EXAMPLE.search(v))} for k, a, z, v in found])
        yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(batch.num_rows)), batch.column(0), batch.column(1), pa.array(spans, kind)], names=["row", "doc_id", "source", "spans"])
        row += batch.num_rows


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, spans of every row."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, f"row long, doc_id long, source string, spans {SPANS}")


def ownership(found: DataFrame) -> DataFrame:
    """value, owners, repositories: distinct sources and documents that hold each value."""
    values = found.where(F.size("spans") > 0).select(F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row"))).alias("repository"), F.coalesce("source", F.lit("\0")).alias("owner"), F.explode("spans.value").alias("value"))
    owners = values.select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("owners"))
    repositories = values.select("value", "repository").distinct().groupBy("value").agg(F.count("*").alias("repositories"))
    return owners.join(repositories, "value")


def secrets(docs: DataFrame, wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """doc_id, spans: kind, start, end, repositories, owners, live; one row for every input row."""
    found = staged(candidates(docs), "op9-spans")
    owned = staged(ownership(found), "op9-owners")
    spans = found.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s"))
    few = (F.col("owners") < wide_owners) & (F.col("repositories") < wide_repositories)
    spans = spans.join(owned, F.col("s.value") == F.col("value")).withColumn("live", few & ~F.col("s.example"))
    told = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), "repositories", "owners", "live"))).alias("told"))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,repositories:bigint,owners:bigint,live:boolean>>)")
    return found.select("row", "doc_id").join(told, "row", "left").select("doc_id", F.coalesce("told", none).alias("spans"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table; an owner is a source."""
    out = secrets(read_table(spark, sf_dir, "documents"))
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    every = F.filter("spans", lambda s: (s["kind"] < 3) | s["live"])
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"), F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))

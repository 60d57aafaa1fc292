"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A text is the sequence of its letters in lower case with one mark for whatever stands between words;
its n-grams are runs of one to three of these with a mark at an end only.  A language's profile is its
`PROFILE` most frequent n-grams over training documents, in order.  A document's `DOC_GRAMS` most
frequent n-grams are compared to each profile by the out-of-place distance: the sum of how far each
one's rank is from its rank in the profile, `PROFILE` at most and for those that the profile lacks.  The
nearest language is predicted; the score is 1 less the share of the greatest possible distance.

Profiles come from a sample of about `FIT_DOCS` training documents of each language (all, if it has
fewer), of the `MOST_LANGS` languages with the most; so the model that is broadcast has MOST_LANGS * PROFILE
entries at most.  N-grams are counted inside tasks over whole texts and summed by language and n-gram;
documents are scored where they are read, without a shuffle.

Edge cases: a null text, and one without a letter, is `und` with score 0, as is every text if no
training document has a language; equal distances go to the language that comes first by code point, equal
counts to the n-gram that does; repeated rows count each; other columns pass through `identified`, with
`in_` before names that it makes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .names import held_out, own_names
from .staging import read_table, ship_code, staged, unstage
from .tally import Tally, runs
from .wordhash import pieces

PROFILE, DOC_GRAMS = 1000, 400
FIT_DOCS, MOST_LANGS = 10_000, 2_000
UNKNOWN = "und"
#: The mark between words, and the bits of a code point.
MARK, BITS = 32, 21
#: Symbols whose n-grams are sorted at once.
STEP = 1 << 21
#: Scores of documents and languages that are held at once.
CELLS = 4_000_000


@cache
def folded() -> np.ndarray:
    """Each code point's letter in lower case; 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters and marks (0) of all texts, each between two marks, and the text that each belongs to."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    long = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(long)), long + 2)
    begin = np.cumsum(long + 2) - long - 2
    out = np.zeros(len(text), np.uint32)
    inside = np.ones(len(text), bool)
    inside[begin] = inside[begin + long + 1] = False
    out[inside] = folded()[points]
    keep = out > 0
    keep[1:] |= out[:-1] > 0
    keep[begin] = True
    return out[keep], text[keep]


def counted(texts: pa.Array, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner (the text's place, or what owner has there), n-gram and count of every owner's n-grams, in order."""
    letters, text = symbols(texts)
    seen = np.zeros(0x110000, bool)
    seen[letters] = seen[0] = True
    alphabet = np.flatnonzero(seen)
    small = np.cumsum(seen, dtype=np.uint64)[letters] - np.uint64(1)
    b = np.uint64(max(int(len(alphabet) - 1).bit_length(), 1))
    if not len(letters):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    who = (text if owner is None else owner[text]).astype(np.uint64) << (np.uint64(3) * b + np.uint64(2))
    tags = [np.uint64(n) << (np.uint64(3) * b) for n in (1, 2, 3)]
    found, counts = [], []
    for begin in range(0, len(small), STEP):  # a very long text takes several steps
        end = min(begin + STEP, len(small))
        key, code, ok = who[begin:end], small[begin:end], small[begin:end] > 0
        keys = [(key | tags[0] | code)[ok]]
        for size, tag in ((2, tags[1]), (3, tags[2])):
            last = small[begin + size - 1 : end + size - 1]
            code = code[: len(last)] << b | last
            ok = ok[: len(last)] | (last > 0) if size == 2 else small[begin + 1 : begin + 1 + len(last)] > 0
            keys.append((key[: len(last)] | tag | code)[ok])
        found.append(np.sort(np.concatenate(keys)))
        at = runs([found[-1]])
        counts.append(np.diff(np.append(at, len(found[-1]))))
        found[-1] = found[-1][at]
    keys, n = found[0], counts[0]
    if len(found) > 1:
        order = np.argsort(np.concatenate(found), kind="stable")
        keys, n = np.concatenate(found)[order], np.concatenate(counts)[order]
        at = runs([keys])
        keys, n = keys[at], np.add.reduceat(n, at)
    alphabet = alphabet.astype(np.int64)
    alphabet[0] = MARK
    mask = (np.uint64(1) << b) - np.uint64(1)
    size = (keys >> (np.uint64(3) * b)) & np.uint64(3)
    parts = [alphabet[(keys >> (np.uint64(i) * b)) & mask] for i in range(3)]  # the last symbol first
    gram = np.where(size == 3, parts[2] << 2 * BITS | parts[1] << BITS | parts[0], np.where(size == 2, parts[1] << 2 * BITS | parts[0] << BITS, parts[0] << 2 * BITS))
    return (keys >> (np.uint64(3) * b + np.uint64(2))).astype(np.int64), gram, n


def ranked(owner: np.ndarray, gram: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, n-gram and rank (from 0) of each owner's most frequent n-grams; the lesser n-gram first among equals."""
    order = np.lexsort((gram, -n, owner))
    owner, gram = owner[order], gram[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    top = rank < most
    return owner[top], gram[top], rank[top]


def count_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, lang -> lang, gram, n: the sums of a task."""
    langs: dict[str, int] = {}
    tally = Tally()

    def rows() -> pa.RecordBatch:
        columns, n = tally.take()
        lang, gram = columns or (n, n)
        names = pa.array(list(langs), pa.string())
        return pa.RecordBatch.from_arrays([names.take(pa.array(lang)), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

    for batch in pieces(batches):
        own = np.array([langs.setdefault(x, len(langs)) for x in batch.column(1).to_pylist()], np.int64)
        owner, gram, n = counted(batch.column(0), own)
        tally.add([owner, gram], n)
        if tally.full:
            yield rows()
    yield rows()


class Profiles:
    """Ranks of all profiles by n-gram."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, rank: np.ndarray) -> None:
        self.langs = langs
        order = np.argsort(gram, kind="stable")
        self.lang, self.rank = lang[order], rank[order].astype(np.int64)
        self.grams, self.begin = np.unique(gram[order], return_index=True)
        self.end = np.append(self.begin[1:], len(gram)).astype(np.int64)

    def nearest(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The nearest language of each text (-1: none) and its score."""
        doc, gram, rank = ranked(*counted(texts), DOC_GRAMS)
        n = np.bincount(doc, minlength=len(texts))
        if not self.langs:
            return np.full(len(texts), -1), np.zeros(len(texts))
        place = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[place] == gram
        doc, rank, place = doc[known], rank[known], place[known]
        long = self.end[place] - self.begin[place]
        entry = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long - self.begin[place], long)
        nearer = PROFILE - np.minimum(np.abs(np.repeat(rank, long) - self.rank[entry]), PROFILE)
        gain = np.bincount(np.repeat(doc, long) * len(self.langs) + self.lang[entry], weights=nearer, minlength=len(texts) * len(self.langs))
        gain = gain.reshape(len(texts), len(self.langs))
        best = gain.argmax(axis=1)
        score = gain[np.arange(len(texts)), best] / np.maximum(n * PROFILE, 1)
        return np.where(n > 0, best, -1), np.where(n > 0, score, 0.0)


def training_rows(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """text and lang of about fit_docs documents of each language, none of them held out."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS)
    share = sizes.select(F.col("lang").alias("of"), F.least(F.lit(1.0), fit_docs / F.col("count")).alias("share"))
    chosen = known.join(F.broadcast(share), F.col("lang") == F.col("of"))  # MOST_LANGS rows
    return chosen.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(12)), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("text", "lang")


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Profiles:
    """The profiles of all languages of docs: doc_id, text, lang."""
    counts = training_rows(docs, fit_docs).mapInArrow(count_by_language, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = staged(counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < PROFILE).select("lang", "gram", "rank"), "op12-profiles")
    table = top.toArrow()  # MOST_LANGS * PROFILE rows at most
    unstage(top)
    langs = sorted(pc.unique(table["lang"]).to_pylist())
    lang = pc.index_in(table["lang"], pa.array(langs, pa.string())).to_numpy().astype(np.int64)
    return Profiles(langs, lang, table["gram"].to_numpy(), table["rank"].to_numpy())


def identify(held):
    """Adds the nearest language and its score to the columns after the first, which is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = held.value
        names = pa.array(profiles.langs, pa.string())
        most = max(CELLS // max(len(profiles.langs), 1), 1)
        for piece in pieces(batches, "__text"):
            for begin in range(0, piece.num_rows, most):
                batch = piece.slice(begin, most)
                best, score = profiles.nearest(batch.column(0))
                found = pc.fill_null(names.take(pa.array(best, pa.int64(), mask=best < 0)), UNKNOWN)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], found, pa.array(score)], names=[*batch.schema.names[1:], "lang_pred", "score"])

    return run


def identified(docs: DataFrame, profiles: Profiles, columns: list[str] | None = None) -> DataFrame:
    """Input columns (all, or those named), lang_pred and score."""
    spark = docs.sparkSession
    ship_code(spark)
    names = own_names(docs.columns if columns is None else columns, ("lang_pred", "score"), ("__text",))
    rows = docs.select(F.col("text").cast("string").alias("__text"), *(F.col(f"`{c}`").alias(name) for c, name in names.items()))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "__text") + "lang_pred string, score double"
    return rows.mapInArrow(identify(spark.sparkContext.broadcast(profiles)), schema)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table; profiles from the documents that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    ship_code(spark)
    out = identified(docs, fit(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

"""Phrase collocations by PrefixSpan-style growth of contiguous patterns (Pei et al., 2001).

Texts in lower case (A-Z only) are cut into pieces at `[.,;:!?\\x0A-\\x0D]` and these into words
`[^\\x20\\x09]+`; everything is counted per language.

1. Words are counted (summed inside tasks first).  Those with `least` occurrences are the prefixes of one
   word; a bit table of them is broadcast, at most `MAX_BITS` large.  A rare word that shares a bit
   with a frequent one costs work, never a result.
2. Each prefix is projected to its occurrence pointers: the words that follow it in the piece, as far as
   a phrase can reach and as long as they are frequent.  Equal suffixes of a task are one pointer with a
   weight, and a task sends a prefix's pointers as one row.
3. All pointers of a prefix meet in one task, which extends it to the right depth first: pointers are
   sorted by the next word, and each word with `least` occurrences is one more pattern, whose own pointers
   are extended in turn.  A prefix with more than `HOT` occurrences (a bounded number of words is)
   is dealt by the whole suffix to several such tasks, whose counts are summed.
4. Candidates are cut at every place; the parts' counts come from joins, since a part of a frequent phrase is
   frequent.  Scores are exact decimals.  Ranks are taken in two steps, so no language is sorted in one task.

Edge cases: a null text is empty; a null lang is `und`, as is that name itself; repeated rows count
each; an empty table gives no rows; other columns are ignored.  Counts may reach 10**15 - 1, beyond that Spark
stops with an overflow.  Words and languages are keyed by 64 bits of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import read_table, ship_code, staged, unstage
from .tally import Tally, runs
from .wordhash import U64, Words, mix, pieces, signed, split_words

LEAST, LONGEST, COVERED, MOST = 10, 3, 50, 2000
SCALE = 1_000_000
UNKNOWN = "und"
#: The bit table: bits for each frequent word, its largest size, and the bits of a segment that one group makes.
BITS_PER_WORD, MAX_BITS, SEGMENT_BITS = 16, 1 << 29, 1 << 19
#: Occurrences beyond which a prefix is dealt to several tasks; HOT_WORDS words at most are so frequent.
HOT, HOT_WORDS = 1 << 16, 2_000_000
#: Pointers that a task merges at once.
POINTERS = 1 << 21
#: Groups of the first step of ranking.
RANK_GROUPS = 64

_PARTS = np.zeros(256, bool)
_PARTS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_SPACE = _PARTS.copy()
_SPACE[[0x20, 0x09]] = True


def keyed_words(batch: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of the column text, the key of each (never 0) in its language, and the place of its text."""
    words = split_words(batch.column("text"), lower=True, space=_SPACE)
    of_lang = {x: int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in pc.unique(batch.column("lang")).to_pylist()}
    lang = np.array([of_lang[x] for x in batch.column("lang").to_pylist()], U64)
    doc = np.repeat(np.arange(batch.num_rows), words.counts)
    return words, np.maximum(mix(words.hashes ^ lang[doc]), U64(1)), doc


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, key, word, n of a task's words; without a key and a word, all words of a language."""
    names = ["lang", "key", "word", "n"]
    tally, known, told = Tally(), np.zeros(0, U64), {}
    total: dict[str, int] = {}

    def rows() -> pa.RecordBatch:
        columns, n = tally.take()
        keys = columns[0] if columns else np.zeros(0, U64)
        lang, word = ([told[k][i] for k in keys.tolist()] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(signed(keys)), pa.array(word, pa.binary()).cast(pa.string()), pa.array(n)], names=names)

    for batch in pieces(batches):
        words, keys, doc = keyed_words(batch)
        langs = batch.column("lang").to_pylist()
        for x, n in zip(langs, words.counts.tolist(), strict=True):
            total[x] = total.get(x, 0) + n
        keys, first, n = np.unique(keys, return_index=True, return_counts=True)
        place = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        new = known[place] != keys if len(known) else np.ones(len(keys), bool)
        raw = words.data.tobytes()
        for k, i, d, a, z in zip(keys[new].tolist(), first[new].tolist(), doc[first[new]].tolist(), words.starts[first[new]].tolist(), words.ends[first[new]].tolist(), strict=True):
            told[k] = langs[d], raw[a:z]
        known = np.union1d(known, keys[new]) if new.any() else known
        tally.add([keys], n.astype(np.int64))
        if tally.full:
            yield rows()
            known, told = known[:0], {}
    yield rows()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.int64()), pa.nulls(len(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=names)


def segment_bits(table: pa.Table) -> pa.Table:
    """One segment of the bit table from the bits that are set in it."""
    bits = np.zeros(SEGMENT_BITS, bool)
    bits[table["bit"].to_numpy()] = True
    return pa.table({"segment": table["segment"].slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def bit_table(keys: DataFrame, size: int) -> np.ndarray:
    """A table of size bits, in bytes, in which the bit of each key is set."""
    at = F.pmod(F.col("key"), F.lit(size))
    marks = keys.select(F.floor(at / SEGMENT_BITS).cast("int").alias("segment"), (at % SEGMENT_BITS).cast("int").alias("bit"))
    out = np.zeros(size // 8, np.uint8)
    for row in marks.groupBy("segment").applyInArrow(segment_bits, "segment int, bits binary").toLocalIterator():  # MAX_BITS in all
        out[row.segment * SEGMENT_BITS // 8 : (row.segment + 1) * SEGMENT_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def project(held, longest: int):
    """prefix, share, pointers: the occurrences of each prefix in a task as rows of following words and a weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot, shares = held.value
        size = U64(8 * len(bits) - 1)
        tally = Tally(POINTERS)

        def rows() -> pa.RecordBatch:
            columns, n = tally.take()
            columns = columns or [np.zeros(0, U64)] * longest
            prefix, share = columns[0], np.zeros(len(n), np.int64)
            if len(hot):
                place = np.minimum(np.searchsorted(hot, prefix), len(hot) - 1)
                own = np.flatnonzero(hot[place] == prefix)
                if len(own):
                    suffix = np.zeros(len(own), U64)
                    for c in columns[1:]:
                        suffix = mix(suffix ^ c[own])
                    share[own] = (suffix % shares[place[own]]).astype(np.int64)
                    group = np.cumsum(np.append(0, prefix[1:] != prefix[:-1])) if len(prefix) else share
                    order = np.lexsort((share, group))
                    columns, n, share = [c[order] for c in columns], n[order], share[order]
                    prefix = columns[0]
            at = np.append(runs([prefix, share]), len(n)).astype(np.int64)
            data = np.column_stack([*columns[1:], n.astype(U64)])
            wide = 8 * data.shape[1]
            packed = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * wide), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(signed(prefix[at[:-1]])), pa.array(share[at[:-1]].astype(np.int32)), packed], names=["prefix", "share", "pointers"])

        for batch in pieces(batches):
            words, keys, doc = keyed_words(batch)
            place = keys & size
            frequent = (bits[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1 > 0
            parted = np.zeros(len(words.data) + 1, np.int64)
            np.cumsum(_PARTS[words.data], out=parted[1:])
            ok = frequent[:-1] & frequent[1:] & (doc[:-1] == doc[1:]) & (parted[words.starts[1:]] == parted[words.ends[:-1]])
            at = np.flatnonzero(ok)
            ok = np.append(ok, np.zeros(longest, bool))
            columns, reach = [keys[at], keys[at + 1]], np.ones(len(at), bool)
            keys = np.append(keys, np.zeros(longest, U64))
            for k in range(2, longest):
                reach = reach & ok[at + k - 1]
                columns.append(np.where(reach, keys[at + k], U64(0)))
            tally.add(columns, np.ones(len(at), np.int64))
            if tally.full:
                yield rows()
        yield rows()

    return run


def grown(prefix: int, pointers: np.ndarray, least: int, whole: bool) -> Iterator[tuple[list[int], int]]:
    """Phrases that begin with the prefix and their occurrences among the pointers, depth first.

    All of those with `least` occurrences; without `whole`, which says that no other task has pointers of
    this prefix, also all shorter ones than a pointer reaches.
    """
    depth, weight = pointers.shape[1] - 1, pointers[:, -1].astype(np.int64)

    def extend(phrase: list[int], own: np.ndarray) -> Iterator[tuple[list[int], int]]:
        k = len(phrase) - 1
        word = pointers[own, k]
        order = np.argsort(word, kind="stable")
        own, word = own[order], word[order]
        own, word = own[word > 0], word[word > 0]
        if not len(word):
            return
        at = runs([word])
        n = np.add.reduceat(weight[own], at)
        end = np.append(at[1:], len(word))
        for i in (range(len(at)) if not whole and k + 1 < depth else np.flatnonzero(n >= least).tolist()):
            longer = [*phrase, int(word[at[i]])]
            yield longer, int(n[i])
            # only whole suffixes are all in one task, so only they can be pruned by what it has of their start
            if k + 1 < depth and (n[i] >= least or not whole and k + 2 < depth):
                yield from extend(longer, own[at[i] : end[i]])

    yield from extend([prefix], np.arange(len(pointers)))


def grow(held, least: int, longest: int):
    """Rows of project sorted by prefix and share -> words (keys), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = held.value[1]
        group, parts, found = None, [], []

        def rows() -> pa.RecordBatch:
            words = np.array([w for phrase, _ in found for w in phrase], U64)
            at = np.cumsum([0, *(len(phrase) for phrase, _ in found)]).astype(np.int32)
            out = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at), pa.array(signed(words))), pa.array([n for _, n in found], pa.int64())], names=["words", "n"])
            found.clear()
            return out

        def close() -> None:
            if parts:
                prefix = group[0] % (1 << 64)
                whole = not len(hot) or hot[min(int(np.searchsorted(hot, U64(prefix))), len(hot) - 1)] != U64(prefix)
                found.extend(grown(prefix, np.frombuffer(b"".join(parts), U64).reshape(-1, longest), least, whole))

        for batch in batches:
            for prefix, share, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (prefix, share) != group:
                    close()
                    group, parts = (prefix, share), []
                parts.append(data)
            if len(found) > 100_000:
                yield rows()
        close()
        yield rows()

    return run


def phrase_counts(rows: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: text, lang -> tables (lang, key, word, n) of frequent words, (lang, n) of all words, (words, n) of longer frequent phrases."""
    spark = rows.sparkSession
    counts = rows.mapInArrow(count_words, "lang string, key long, word string, n long").groupBy("lang", "key", "word").agg(F.sum("n").alias("n"))
    counts = staged(counts.where((F.col("n") >= least) | F.col("word").isNull()), "op11-words")
    words, totals = counts.where("word is not null"), counts.where("word is null").select("lang", "n")
    known, total = words.count(), totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = min(max(1 << (known * BITS_PER_WORD).bit_length(), SEGMENT_BITS), MAX_BITS)
    limit = max(HOT, total // HOT_WORDS)
    hot = words.where(F.col("n") > limit).select("key", F.ceil(F.col("n") / limit).cast("long").alias("shares")).toArrow()  # HOT_WORDS rows at most
    keys, shares = (hot[c].to_numpy().view(U64) for c in ("key", "shares"))
    held = spark.sparkContext.broadcast((bit_table(words, size), np.sort(keys), shares[np.argsort(keys)]))
    pointers = rows.mapInArrow(project(held, longest), "prefix long, share int, pointers binary")
    found = pointers.repartition("prefix", "share").sortWithinPartitions("prefix", "share").mapInArrow(grow(held, least, longest), "words array<long>, n long")
    return words, totals, staged(found.groupBy("words").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "op11-phrases")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, most: int = MOST) -> DataFrame:
    """docs: text, lang -> each language's first phrases of 2 to longest words: lang, rank, phrase, a, l, r, n, score.

    A phrase with a occurrences (`least` at least) is cut where SCALE * a * a / (l * r) is least, l and r
    being the occurrences of the parts; one inside a longer phrase with `covered` percent of its occurrences goes.
    """
    ship_code(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    words, totals, phrases = phrase_counts(rows, least, longest)
    parts = phrases.unionByName(words.select(F.array("key").alias("words"), "n"))
    cuts = phrases.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    cuts = cuts.join(parts.select(F.col("words").alias("left"), F.col("n").alias("l")), "left").join(parts.select(F.col("words").alias("right"), F.col("n").alias("r")), "right")
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    scored = cuts.groupBy("words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = phrases.where(F.size("words") > 2).select(F.col("n").alias("longer"), "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size"))
    inner = inner.select("longer", F.explode(F.expr("transform(sequence(1, size(words) - size + 1), i -> slice(words, i, size))")).alias("words"))
    longer = inner.groupBy("words").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, "words", "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    kept = staged(kept.select("words", "a", "cut.score", "cut.l", "cut.r"), "op11-kept")
    spelt = kept.select("words", F.posexplode("words").alias("at", "key")).join(words.select("key", "lang", "word"), "key")
    spelt = spelt.groupBy("words").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = kept.join(spelt, "words").select("lang", "phrase", "a", "l", "r", "score", F.pmod(F.xxhash64("words"), F.lit(RANK_GROUPS)).alias("group"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).where(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table: phrases of 2 and 3 words with 10 occurrences, the first 2000 of each language."""
    out = collocations(read_table(spark, sf_dir, "documents"))
    return out.withColumn("rank", F.col("rank").cast("long"))


ORACLE_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
grams AS (SELECT lang, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, {LONGEST + 1}) AS v(k))),
f AS (SELECT lang, g, count(*) AS n FROM grams GROUP BY lang, g HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT c.lang, c.g, c.n AS a, k, l.n AS l, r.n AS r, ({SCALE}::HUGEINT * c.n * c.n // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM (SELECT lang, g, n, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1) c
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, g[i:i + s - 1] AS g, max(n) AS longer FROM (SELECT lang, g, n, s, unnest(range(1, len(g) - s + 2)) AS i FROM f, range(2, {LONGEST}) AS v(s) WHERE len(g) > s) GROUP BY ALL),
kept AS (SELECT s.*, array_to_string(s.g, ' ') AS phrase FROM scored s LEFT JOIN inner_phrases i ON i.lang = s.lang AND i.g = s.g WHERE longer IS NULL OR 100 * longer < {COVERED} * a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
FROM kept k JOIN totals t ON t.lang = k.lang QUALIFY rank <= {MOST}
"""

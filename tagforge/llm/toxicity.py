"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding: lower case, accents off, look-alike letters of other scripts to Latin, digits and signs
that stand for letters (when a letter follows), invisible characters away, every other run of
non-letters one space.  Entries are word starts or whole words; a hit inside an exception phrase
doesn't count.

Entries and weights are learned from how often word starts and words occur, a word, in toxic and in
other labelled documents: an entry's weight is the smoothed log of the two rates' ratio, and it is
kept if that weight less `z` standard errors (from document counts) reaches a floor.  Of nested
entries the longer stays if it is clearly purer or about as frequent, and the shorter is weighed by
what is left.  Each word counts by its longest entry.  The sum of hits and its density (the sum a
hundred words) are put on a logarithmic scale, and one logistic curve over both gives the score, so
a chance hit in a long text weighs little.

`z` and the floor are chosen among `CHOICES` by cross-validation over `FOLDS` folds of the training
rows, and the curve is fitted to features of rows that their lexicon has not seen.  Phrases of two
words around an entry become exceptions, beside the given ones, where training documents show them
to be no sign of toxicity.  Equal texts count once.  The fit takes at most about `FIT_ROWS` labelled
rows, chosen by a hash of doc_id, so its cost and the lexicon are bounded; scores cover every whole
text.

Edge cases: rows labelled twice count as toxic if any label says so; null labels are no labels;
without toxic or without other labels the lexicon is empty and all scores are the prior; null and
empty texts get the score of no hit; a null doc_id is scored and never held out; an input column
`toxicity` becomes in_toxicity.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import held_out, own_names
from .staging import read_table, ship_code, staged
from .wordhash import pieces

FIT_ROWS = 20_000
FOLDS = 4
#: Standard errors to stay clear of, and the least weight left then.
CHOICES = [(z, least) for z in (2.0, 3.0) for least in (0.7, 1.5)]
THRESHOLD = 0.3
#: Entries that a task counts before it hands them on.
HELD_ENTRIES = 100_000
STARTS = (3, 4, 5, 6, 7)
#: Phrases in which an entry is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown")

# Characters that look like Latin letters, and those that stand for letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
INVISIBLE = "­​‌‍⁠﻿"

_SIGN = re.compile(r"[013457890@$!|€]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_TABLE = str.maketrans(LOOKALIKES | dict.fromkeys(INVISIBLE))
_ALIKE = re.compile(f"[{''.join(LOOKALIKES)}{INVISIBLE}]")
_SIGNS = str.maketrans(SIGNS)
_GAPS = str.maketrans({chr(i): " " for i in range(128) if not chr(i).isalnum()})
#: Combining marks; those beyond the first 65,536 code points would make the pattern slow.
_MARK = re.compile("[" + "".join(chr(i) for i in range(0x10000) if unicodedata.combining(chr(i))) + "]")


def fold(text: str | None) -> str:
    """Folded words with a space before and after each."""
    text = (text or "").lower()
    if not text.isascii():
        text = text.translate(_TABLE) if _ALIKE.search(text) else text
        if not text.isascii():
            text = _MARK.sub("", unicodedata.normalize("NFKD", text)).lower()
            text = text.translate(_TABLE) if _ALIKE.search(text) else text
    text = _SIGN.sub(lambda m: m[0].translate(_SIGNS), text)
    words = text.translate(_GAPS).split() if text.isascii() else _WORD.findall(text)
    return f" {' '.join(words)} "


def entries_of(folded: str) -> Counter:
    """Counts of word starts (a space before) and whole words (a space at both ends)."""
    out: Counter = Counter()
    for w, n in Counter(folded.split()).items():
        out[f" {w} "] += n
        for k in STARTS:
            if len(w) >= k:
                out[f" {w[:k]}"] += n
    return out


def count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entry, fold, toxic, occurrences, documents; the empty entry counts all words and documents."""
    held: dict[tuple[int, bool], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (fold_no, toxic), (n, docs) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array([fold_no] * len(n), pa.int32()), pa.array([toxic] * len(n)), pa.array(list(n.values()), pa.int64()), pa.array([docs[e] for e in n], pa.int64())], names=["entry", "fold", "toxic", "n", "docs"])
        held.clear()

    for batch in pieces(batches):
        for text, fold_no, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            folded = fold(text)
            found = entries_of(folded)
            found[""] = len(folded.split())
            n, docs = held.setdefault((fold_no, toxic), (Counter(), Counter()))
            n.update(found)
            docs.update(found.keys())
            if sum(len(n) for n, _ in held.values()) > HELD_ENTRIES:
                yield from flush()
    yield from flush()


class Lexicon:
    """Weighted entries and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        phrases = [fold(p) for p in exceptions] if weights else []
        for p in phrases:
            if p not in self.automaton:
                self.automaton.add_word(p, (len(p), None))
        self.empty = not weights
        if weights:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """Where a word with an entry begins, and the weight of its longest one."""
        best: dict[int, tuple[int, float]] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            begin = end - size + 1
            if weight is None:
                excused.append((begin, end))
            else:
                best[begin] = max(best.get(begin, (0, 0.0)), (size, weight))
        return [(at, w) for at, (_, w) in best.items() if not any(a <= at < z for a, z in excused)]

    def features(self, folded: str) -> tuple[float, float]:
        """Logarithms of the sum of hits and of its density."""
        total = 0.0 if self.empty else sum(w for _, w in self.hits(folded))
        return math.log1p(total), math.log1p(100 * total / max(folded.count(" ") - 1, 1))


def weigh(t: float, c: float, toxic_words: int, other_words: int) -> float:
    return math.log((t + 0.5) / (toxic_words + 1)) - math.log((c + 0.5) / (other_words + 1))


def choose(counts: list[tuple[str, int, int, int, int]], toxic_words: int, other_words: int, z: float, least: float) -> dict[str, float]:
    """counts: (entry, occurrences in toxic documents, in others, such documents) -> weight of each entry worth keeping."""
    sure = lambda w, dt, dc: dt >= 2 and w - z * math.sqrt(1 / (dt + 0.5) + 1 / (dc + 0.5)) >= least
    kept: dict[str, tuple[int, int, int, int]] = {}
    above: dict[str, str | None] = {}
    for entry, t, c, dt, dc in sorted(counts, key=lambda x: (len(x[0]), x[0])):
        if not sure(weigh(t, c, toxic_words, other_words), dt, dc):
            continue
        over = max((entry[:n] for n in range(2, len(entry)) if entry[:n] in kept), key=len, default=None)
        if over is not None:
            by_chance = t * (kept[over][1] + 0.5) / (kept[over][0] + 0.5)
            purer = by_chance >= 4 and c <= by_chance / 4
            if not purer and (entry.endswith(" ") or t < 0.95 * kept[over][0]):
                continue
        kept[entry], above[entry] = (t, c, dt, dc), over
    left = {e: x[:2] for e, x in kept.items()}
    for entry, over in above.items():
        if over is not None:
            left[over] = (left[over][0] - kept[entry][0], left[over][1] - kept[entry][1])
    # what a longer entry leaves of a shorter one is weighed alone
    out = {}
    for e, (t, c) in left.items():
        share = t / max(kept[e][0], 1)
        w = weigh(t, max(c, 0), toxic_words, other_words) if t > 0 else -math.inf
        if share >= 0.05 and sure(w, kept[e][2] * share, kept[e][3] * min(1.0, max(c, 0) / max(kept[e][1], 1))):
            out[e] = w
    return out


def of_folds(rows: list, but: int | None) -> tuple[list[tuple[str, int, int, int, int]], int, int, int, int]:
    """Counts over all folds but one: those of entries, words and documents of each class."""
    kept = [i for i in range(FOLDS) if i != but]
    out, total = [], (0, 0, 0, 0)
    for r in rows:
        found = tuple(sum(r[name][i] for i in kept) for name in ("t", "c", "dt", "dc"))
        if r["entry"]:
            out.append((r["entry"], *found))
        else:
            total = found
    return out, *total


def logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Intercept and slopes of a ridge-regularised logistic curve, by Newton steps that must gain."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    beta[0] = math.log(prior / (1 - prior))
    ridge = np.full(len(beta), 0.1)
    ridge[0] = 0.01

    def loss(v: np.ndarray) -> float:
        z = design @ v
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + (ridge * v * v).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(design.T @ (design * w[:, None]) + np.diag(ridge), design.T @ (y - p) - ridge * beta)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-8 or size <= 1e-6:
            break
    return beta.tolist()


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, fold, toxic of labelled rows that aren't held out, each text once."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.max("toxic") > 0).alias("toxic"))
    share = min(1.0, FIT_ROWS / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("label_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "label_id")  # FIT_ROWS at most
    rows = rows.groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("text_hash")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return rows.select("text", F.pmod(F.xxhash64("text_hash"), F.lit(FOLDS)).cast("int").alias("fold"), "toxic")


def count_table(rows: DataFrame) -> list:
    """Entries that the least strict choice could keep: occurrences t, c and documents dt, dc by fold, and the totals."""
    counts = rows.mapInArrow(count_entries, "entry string, fold int, toxic boolean, n long, docs long")
    cell = lambda what, toxic, i: F.coalesce(F.sum(F.when((F.col("toxic") == toxic) & (F.col("fold") == i), F.col(what))), F.lit(0))
    by_fold = lambda what, toxic: F.array(*(cell(what, toxic, i) for i in range(FOLDS)))
    table = counts.groupBy("entry").agg(by_fold("n", True).alias("t"), by_fold("n", False).alias("c"), by_fold("docs", True).alias("dt"), by_fold("docs", False).alias("dc"))
    total = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x)
    table = staged(table.where((F.col("entry") == "") | (total("dt") >= 2)), "op5-entries")
    words = table.where("entry = ''").first()
    if words is None:
        return []
    # a fold left out changes a weight by little, so a share of the least choice is enough here
    ratio = math.exp(0.5 * min(least for _, least in CHOICES)) * (sum(words["t"]) + 1) / (sum(words["c"]) + 1)
    return table.where((F.col("entry") == "") | (total("t") + 0.5 >= (total("c") + 0.5) * ratio)).collect()  # bounded by FIT_ROWS


def seen_features(lexicons: dict[tuple[int, int], dict[str, float]], n_choices: int):
    """toxic and, for every choice, the features by the lexicon that hasn't seen the row's fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {k: Lexicon(w) for k, w in lexicons.items()}
        for batch in pieces(batches):
            out = []
            for text, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = fold(text)
                out.append([x for i in range(n_choices) for x in made[i, f].features(folded)])
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def phrases_of(weights: dict[str, float]):
    """phrase, toxic, documents: entries' words with the word before and the one after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights, ())
        for batch in pieces(batches):
            out = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded, found = fold(text), set()
                for at, _ in lexicon.hits(folded):
                    end = folded.index(" ", at + 1)
                    word, before = folded[at + 1 : end], folded[folded.rfind(" ", 0, at) + 1 : at]
                    after = folded[end + 1 : max(folded.find(" ", end + 1), 0)]
                    found.update(f"{a} {b}" for a, b in ((before, word), (word, after)) if a and b)
                out.update((p, toxic) for p in found)
            yield pa.RecordBatch.from_pydict({"phrase": [p for p, _ in out], "toxic": [t for _, t in out], "n": list(out.values())}, schema=pa.schema([("phrase", pa.string()), ("toxic", pa.bool_()), ("n", pa.int64())]))

    return run


def learned_exceptions(rows: DataFrame, weights: dict[str, float], n_toxic: int, n_other: int) -> list[str]:
    """Phrases around an entry whose weight, two standard errors included, is no sign of toxicity."""
    counts = rows.select("text", "toxic").mapInArrow(phrases_of(weights), "phrase string, toxic boolean, n long")
    either = lambda toxic: F.sum(F.when(F.col("toxic") == toxic, F.col("n")).otherwise(0))
    table = counts.groupBy("phrase").agg(either(True).alias("t"), either(False).alias("c")).where("c >= 3")
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    w = F.log(t / (n_toxic + 1)) - F.log(c / (n_other + 1))
    return sorted(r.phrase for r in table.where(w + 2 * F.sqrt(1 / t + 1 / c) <= 0).collect())  # bounded by FIT_ROWS


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[str], list[float]]:
    """Entry weights, exception phrases, and the curve's intercept and slopes."""
    rows = staged(training_rows(docs, labels), "op5-rows")
    counts = count_table(rows)
    _, _, _, n_toxic, n_other = of_folds(counts, None)
    if not n_toxic or not n_other:
        return {}, [], [math.log((n_toxic + 0.5) / (n_other + n_toxic + 9.5)), 0.0, 0.0]
    lexicons = {}
    for f in range(FOLDS):
        found, tw, cw, _, _ = of_folds(counts, f)
        for i, (z, least) in enumerate(CHOICES):
            lexicons[i, f] = choose(found, tw, cw, z, least)
    seen = rows.mapInArrow(seen_features(lexicons, len(CHOICES)), "toxic boolean, x array<double>").toArrow()  # FIT_ROWS at most
    y = seen["toxic"].to_numpy().astype(float)
    x = np.array(seen["x"].to_pylist()).reshape(len(y), -1)
    curves = [logistic(x[:, 2 * i : 2 * i + 2], y) for i in range(len(CHOICES))]
    loss = [float(np.logaddexp(0, -(2 * y - 1) * (k[0] + x[:, 2 * i : 2 * i + 2] @ np.array(k[1:]))).sum()) for i, k in enumerate(curves)]
    best = int(np.argmin(loss))
    found, tw, cw, _, _ = of_folds(counts, None)
    weights = choose(found, tw, cw, *CHOICES[best])
    return weights, learned_exceptions(rows, weights, n_toxic, n_other) if weights else [], curves[best]


def score_rows(weights: dict[str, float], exceptions: list[str], curve: list[float]):
    """Adds the score as a last column; the first column is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights, [*EXCEPTIONS, *exceptions])
        for batch in pieces(batches, "__text"):
            found = np.array([lexicon.features(fold(t)) for t in batch.column(0).to_pylist()])
            logits = np.clip(curve[0] + found @ np.array(curve[1:]), -30, 30)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(1 / (1 + np.exp(-logits)))], names=[*batch.schema.names[1:], "toxicity"])

    return run


def scored(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Input columns (all, or those named) and toxicity, a score from 0 to 1."""
    spark = docs.sparkSession
    ship_code(spark)
    model = fit(docs, labels)
    names = own_names(docs.columns if columns is None else columns, ("toxicity",), ("__text",))
    rows = docs.select(F.col("text").cast("string").alias("__text"), *(F.col(f"`{c}`").alias(name) for c, name in names.items()))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "__text") + "toxicity double"
    return rows.mapInArrow(score_rows(*model), schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, learned from the labels that aren't held out."""
    out = scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))

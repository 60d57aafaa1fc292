"""How document filters interact, from a walk over the trie of their orders.

The walk goes depth first from all documents.  A node is a set of filters already applied; its
survivors are a persisted DataFrame, made from its parent's by one more filter and released once its
children are done.  Orders that reach the same set share the node (memoised), so n filters have 2**n
nodes instead of n! paths, and every edge (a node and one filter more) is counted on the survivors
that are there: what the filter removes, and how much of that is good or toxic.  The rows of all
orders follow from a join of the edges with a fixed table of orders.

Survivors that are lost with an executor are filtered again from the flags, a table in the shared
folder.  Nothing but plans passes through the driver, however many parts there are.

Edge cases: a null text is empty; a null source is the part ''; a row with a null doc_id is a copy
of nothing and nothing is a copy of it; rows that repeat a doc_id with the same text aren't copies of
each other; a document is good or toxic if one of its labels says so, and neither without one; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import read_table, staged, unstage

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, LEAST_DIFFERENT, MOST_CAPITALS, SYMBOL = 50, 65, 5, "[#$%&*|]"
LETTERS = "ABCDE"
COUNTS = ["removed", "good_lost", "toxic_lost"]


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D; the words are taken once."""
    words = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different")))
    told = lambda w: (w["n"] < MIN_WORDS).cast("int").bitwiseOR(F.when(100 * w["different"] < LEAST_DIFFERENT * w["n"], 2).otherwise(0))
    of_words = F.get(F.transform(words, told), 0)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [of_words.bitwiseAND(1) > 0, of_words.bitwiseAND(2) > 0, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(SYMBOL)]


def bits(failures: list[Column], first: int = 0) -> Column:
    return reduce(lambda a, b: a + b, (F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures, first)))


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bit i: fails filter i of LETTERS), good, toxic of every document; a table of the shared folder."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = staged(rows.select("doc_id", "part", bits(text_failures(F.col("t"))).alias("own"), F.unhex(F.sha2(F.encode("t", "UTF-8"), 256)).alias("digest")), "op13-rows")
    # joined from exchanges of their own, so that a hot text or id can be split
    copies = staged(rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"), "op13-copies")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = staged(marks.where("good or toxic"), "op13-labels")
    told = rows.join(copies, "digest", "left").select("doc_id", "part", (F.col("own") + bits([F.col("first") < F.col("doc_id")], 4)).alias("fails"))
    either = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    out = staged(told.join(marks, "doc_id", "left").select("part", F.col("fails").cast("byte").alias("fails"), either("good"), either("toxic")), "op13-flags")
    for used in (rows, copies, marks):
        unstage(used)
    return out


def fails(i: int) -> Column:
    return F.col("fails").bitwiseAND(1 << i) > 0


def edges(rows: DataFrame, n: int) -> DataFrame:
    """state, filter, part, before and COUNTS: rows that reach a state (a bit for each filter applied) and lose some to one filter more."""
    found: dict[int, DataFrame] = {}

    def visit(state: int, reached: DataFrame) -> None:
        reached = reached.persist(StorageLevel.MEMORY_AND_DISK)
        left = [i for i in range(n) if not state >> i & 1]
        removed = lambda i: F.struct(F.lit(i).alias("filter"), F.count_if(fails(i)).alias("removed"), F.count_if(fails(i) & F.col("good")).alias("good_lost"), F.count_if(fails(i) & F.col("toxic")).alias("toxic_lost"))
        counted = reached.groupBy("part").agg(F.count("*").alias("before"), F.array(*map(removed, left)).alias("edge"))
        found[state] = staged(counted.select(F.lit(state).alias("state"), "part", "before", F.explode("edge").alias("edge")).select("state", "part", "before", "edge.*"), "op13-edges")
        for i in left:
            if (state | 1 << i) not in found and len(left) > 1:
                visit(state | 1 << i, reached.where(~fails(i)))
        reached.unpersist()

    visit(0, rows)
    return reduce(DataFrame.unionByName, found.values())


def audit(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """rows: part, fails, good, toxic -> part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark, n = rows.sparkSession, len(letters)
    failing = lambda i: F.struct(F.lit(i).alias("filter"), F.count_if(fails(i)).alias("failing"), F.count_if(F.col("fails") == 1 << i).alias("unique_fails"))
    parts = staged(rows.groupBy("part").agg(F.array(*map(failing, range(n))).alias("x")).select("part", F.explode("x").alias("x")).select("part", "x.*"), "op13-parts")
    # every part has every edge, where nothing gets there too
    states = F.array(*map(F.lit, range(1 << n)))
    every = parts.withColumn("state", F.explode(states)).where(F.expr("state & shiftleft(1, filter) = 0"))
    counted = staged(every.join(edges(rows, n), ["state", "filter", "part"], "left").fillna(0, ["before", *COUNTS]), "op13-counted")
    # an edge of a state of k filters lies on k! (n - 1 - k)! orders
    size = F.bit_count("state")
    ways = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), size + 1)
    shapley = counted.groupBy("part", "filter").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    orders = [("".join(letters[i] for i in p), k + 1, sum(1 << i for i in p[:k]), p[k]) for p in permutations(range(n)) for k in range(n)]
    table = spark.createDataFrame(orders, "filter_order string, step int, state int, filter int")
    out = counted.join(shapley, ["part", "filter"]).join(F.broadcast(table), ["state", "filter"])  # 600 rows for five filters
    return out.select("part", "filter_order", "step", (F.col("before") - F.col("removed")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table by source, in all 120 orders of five filters."""
    return audit(flags(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(LETTERS))
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flagged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {{
    'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t),
    'D': regexp_matches(t, '{SYMBOL}'), 'E': coalesce(first < doc_id, false)}} AS f
  FROM d JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
masks AS (SELECT part, (CASE WHEN f.A THEN 'A' ELSE '' END || CASE WHEN f.B THEN 'B' ELSE '' END || CASE WHEN f.C THEN 'C' ELSE '' END || CASE WHEN f.D THEN 'D' ELSE '' END || CASE WHEN f.E THEN 'E' ELSE '' END) AS m,
  count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM flagged GROUP BY ALL),
orders AS (SELECT o AS filter_order, k AS step, substr(o, k, 1) AS c, substr(o, 1, k - 1) AS before FROM (VALUES {_ORDERS}) AS v(o), range(1, 6) AS r(k)),
steps AS (
  SELECT part, filter_order, step::INT AS step, c,
    sum(CASE WHEN translate(m, before || c, '') = m THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN translate(m, before, '') = m AND contains(m, c) THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN translate(m, before, '') <> m AND contains(m, c) THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN m = c THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN translate(m, before, '') = m AND contains(m, c) THEN g ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN translate(m, before, '') = m AND contains(m, c) THEN x ELSE 0 END)::BIGINT AS toxic_lost
  FROM masks, orders GROUP BY part, filter_order, step, c)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM steps
"""

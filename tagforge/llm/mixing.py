"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets: `share` times all sizes is dealt to the sources by weight.  A source takes at most `most`
times its own size and what is over goes to the others by weight, which ends at the level L with
target = least(most * size, weight * L); L follows from one sort of the sources by size / weight.

Copies: a source whose target is r times its size takes floor(r) whole copies of every document for
certain, and the rest from one more sample: documents in order of u / (1 - u) divided by their
inclusion odds f / (1 - f) * w (Rosen's Pareto order), as long as the taken sizes stay within the
rest.  u is a hash of the document's id and text, w the odds weight of a document (here the root of
its size over its source's mean, so long documents are likelier).  The document at the boundary is
taken if that comes nearer to the target, so a source misses its target by half a document at most.

The order of a hot source isn't sorted in one task: sizes are summed in `BINS` bins of the key, the
boundary bin follows from running sums of the bins, and only documents of that one bin are ranked.

The group of equal rows at the boundary is taken as far as it fits, row by row; which of them doesn't matter,
so they are counted and dealt out by number, however many they are.

Sources are ordered and their level is found without gathering them: sorted parts are numbered, and the level
comes from rounds of one aggregation each, until no more source is full.

Edge cases: a null or empty text has size 0 and is taken 0 words; a null source is one more
source, last in order; rows that repeat an id, text and source are entries of their own that tie; an empty table
gives an empty result; other columns pass through `mixed` under their own names, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import read_table, staged

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BINS = 1 << 14
#: Equal rows that one task makes again.
EQUAL_ROWS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def placed(sizes: DataFrame) -> DataFrame:
    """sizes with place, the number of each source (from 0) by code point, null last; no task sorts them all."""
    ordered = staged(sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("__part", F.spark_partition_id()), "op4-sources")
    parts = ordered.groupBy("__part").agg(F.count("*").alias("n"))  # a row a task
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last())
    numbered = ordered.join(F.broadcast(parts), F.col("__part") == F.col("__p")).withColumn("place", F.row_number().over(inside) - 1 + F.col("__before"))
    return numbered.select(*sizes.columns, "place")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source, source_size and more (one row a source) -> also weight, target."""
    ranked = placed(sizes).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1))
    ranked = staged(ranked.withColumn("full", (F.col("source_size") * most).cast("double")), "op4-weights")
    goal, level, n_full = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share, 0.0, None
    while True:  # the level rises while sources are found full below it
        fill = F.col("full") / F.col("weight") < level
        full, weight, n = ranked.agg(F.sum(F.when(fill, F.col("full"))), F.sum(F.when(~fill, F.col("weight"))), F.count_if(fill)).first()
        if not weight or n == n_full:
            break
        level, n_full = (goal - (full or 0.0)) / weight, n
    target = F.least(F.col("full"), F.col("weight") * F.lit(level)) if weight else F.col("full")
    return ranked.withColumn("target", target).drop("full", "place")


def uniform(doc_id, text) -> F.Column:
    """A number in (0, 1) from 52 bits of a digest: the same at every run."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", doc_id.cast("string"), text)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sampled(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, text: str = "text") -> DataFrame:
    """doc_id, source, u, size, source_size, target, copies (how often the mix takes the row); for rows of a group of
    equal ones that is taken in part also same, their number, and fits, how many of them get one copy more."""
    word_size = n_words(F.col(text))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_size.alias("size"), uniform(F.col("doc_id"), F.col(text)).alias("u"))
    rows = staged(rows, "op4-sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(sums, weights, share, most).withColumnRenamed("source", "s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("sure", F.least(F.floor(ratio), F.lit(most)).cast("int")).withColumn("rest", F.greatest(F.col("target") - F.col("sure") * F.col("source_size"), F.lit(0.0)))
    plan = staged(plan, "op4-plan")
    part = F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0)
    odds = part / (1 - part) * F.sqrt(F.col("size") * F.col("n") / F.col("source_size"))
    ranked = rows.join(plan, rows["source"].eqNullSafe(plan["s"])).drop("s")
    ranked = ranked.withColumn("key", F.when((F.col("size") > 0) & (F.col("rest") > 0), F.col("u") / (1 - F.col("u")) / odds))
    # key / (1 + key) lies in (0, 1); most of the order's mass is spread evenly over it
    ranked = ranked.withColumn("bin", F.floor(F.col("key") / (1 + F.col("key")) * BINS).cast("int"))
    bins = ranked.where("key is not null").groupBy("source", "bin", "rest").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edge = bins.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0))).where("before < rest").groupBy("source").agg(F.max(F.struct("bin", "before")).alias("e")).select(F.col("source").alias("s"), F.col("e.bin").alias("edge"), F.col("e.before").alias("before"))
    edge = staged(edge, "op4-edge")
    ranked = ranked.join(edge, ranked["source"].eqNullSafe(edge["s"]), "left").drop("s")
    last = ranked.where("bin = edge").groupBy("source", "key", "doc_id", "u", "before", "rest", "source_size", "target", "sure").agg(F.sum("size").alias("all"), F.count("*").alias("same"))
    inner = Window.partitionBy("source").orderBy("key", "doc_id", "u")
    one = F.col("all") / F.col("same")
    last = last.withColumn("ahead", F.sum("all").over(inner) - F.col("all") + F.col("before"))
    # a row is taken while its middle lies within the rest; the quotient may be off by one
    within = lambda n: F.col("ahead") + n * one - one / 2 <= F.col("rest")
    near = F.floor((F.col("rest") - F.col("ahead")) / one + 0.5)
    fits = F.when(within(near + 1), near + 1).when(within(near), near).otherwise(near - 1)
    last = last.withColumn("fits", F.least(F.col("same"), F.greatest(F.lit(0), fits)).cast("long"))
    last = staged(last.withColumn("size", one.cast("long")), "op4-last")
    split = (F.col("fits") > 0) & (F.col("fits") < F.col("same"))
    marks = last.where("fits > 0").select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("u").alias("v"), split.alias("split"))
    ranked = ranked.join(marks, ranked["source"].eqNullSafe(marks["s"]) & ranked["doc_id"].eqNullSafe(marks["d"]) & (ranked["u"] == marks["v"]), "left")
    extra = F.coalesce((F.col("bin") < F.col("edge")) | F.col("v").isNotNull(), F.lit(False)).cast("int")
    columns = ["doc_id", "source", "u", "size", "source_size", "target"]
    whole = ranked.where(~F.coalesce("split", F.lit(False))).select(*columns, (F.col("sure") + extra).alias("copies"), F.lit(None).cast("long").alias("fits"), F.lit(None).cast("long").alias("same"))
    # one group a source at most is taken in part: its rows are made again from their number, in blocks
    blocks = last.where(split).withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((F.col("same") - 1) / EQUAL_ROWS)))).repartition("source", "b")
    number = F.explode(F.sequence(F.col("b") * EQUAL_ROWS + 1, F.least(F.col("same"), (F.col("b") + 1) * EQUAL_ROWS)))
    parts = blocks.withColumn("i", number).select(*columns, (F.col("sure") + (F.col("i") <= F.col("fits")).cast("int")).alias("copies"), "fits", "same")
    return whole.unionByName(parts)


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The input rows, each as often as the mix takes it."""
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("source").cast("string").alias("s"), uniform(F.col("doc_id"), F.col("text")).alias("u"), F.struct(*(F.col(f"`{c}`").alias(n) for c, n in own.items())).alias("row"))
    want = staged(sampled(docs, weights, share, most).where("copies > 0 or fits is not null").groupBy(F.col("doc_id").alias("wd"), F.col("source").alias("ws"), F.col("u").alias("wu")).agg(F.max("copies").alias("copies"), F.max("fits").alias("fits"), F.max("same").alias("same")), "op4-want")
    both = rows.join(want, rows["d"].eqNullSafe(want["wd"]) & rows["s"].eqNullSafe(want["ws"]) & (rows["u"] == want["wu"]))
    taken = both.where("fits is null").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row")
    # of equal rows taken in part, those of equal other columns are counted; `fits` of all get one copy more
    split = both.where("fits is not null").groupBy("wd", "ws", "wu", "copies", "fits", "same", F.to_json("row").alias("key")).agg(F.count("*").alias("n"), F.first("row").alias("row"))
    before = Window.partitionBy("wd", "ws", "wu").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    more = F.least(F.col("n"), F.greatest(F.lit(0), F.col("fits") - F.col("ahead")))
    split = split.withColumn("copies", (F.col("copies") - 1) * F.col("n") + more).where("copies > 0")
    split = split.withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / EQUAL_ROWS)))).repartition("ws", "b")
    number = F.explode(F.sequence(F.col("b") * EQUAL_ROWS + 1, F.least(F.col("copies"), (F.col("b") + 1) * EQUAL_ROWS)))
    out = taken.unionByName(split.withColumn("i", number).select("row"))
    return out.select(*(F.col(f"row.{n}").alias(c) for c, n in own.items()))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table: weights 3, 1, 2 in turn, 150 % of all words, twice a source at most."""
    out = sampled(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


ORACLE_SQL = f"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, text)), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r} AS u
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM rows GROUP BY source),
placed AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS fill FROM sums),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(fill) OVER (ORDER BY fill / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY fill / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM placed),
held AS (SELECT arg_min(level, fill / weight) AS level FROM levels WHERE fill / weight >= level),
aims AS (SELECT source, source_size, n, least(fill, weight * held.level) AS target FROM levels, held),
plan AS (SELECT *, floor(target / nullif(source_size, 0)) AS sure, target - floor(target / nullif(source_size, 0)) * source_size AS rest FROM aims),
keyed AS (
  SELECT r.doc_id, r.size, r.u, p.*, CASE WHEN r.size > 0 AND p.rest > 0 THEN
    r.u / (1 - r.u) / (p.rest / p.source_size / (1 - p.rest / p.source_size) * sqrt(r.size::DOUBLE * p.n / p.source_size)) END AS k
  FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source),
ranked AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, u ROWS UNBOUNDED PRECEDING) AS upto FROM keyed WHERE k IS NOT NULL
  UNION ALL SELECT *, NULL FROM keyed WHERE k IS NULL)
SELECT doc_id, size, source_size, target, (size * (coalesce(sure, 0) + CASE WHEN upto - size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM ranked
"""

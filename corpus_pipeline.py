"""The training-data pipeline: five stages, each one operator of tagforge.llm over all rows that the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as
Parquet to the shared folder and reads it as the next stage's documents.  All but the last return
the columns of documents.

1. toxicity: documents with a score of 0.3 or more go.
2. line_dedup: lines found in several documents stay in the first; n_chars follows the text.
3. near_dedup: one document of each group of near duplicates stays (five words, 0.8).
4. mix_sources: each document as often as the mix of sources takes it.
5. bpe: token ids of every text, and the text decoded from them.

Edge cases are those of the operators: a repeated row is one more document, but rows that repeat a
doc_id stay or go together in near_dedup and are one document in line_dedup.  Columns keep their
names and values whatever an operator calls its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagforge.llm import bpe, line_dedup, minhash_dedup, mixing, toxicity
from tagforge.llm.staging import read_table, staged


def plain_names(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id, text and the other columns under names that no operator makes, and those names."""
    own = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"__own{i}") for i, c in enumerate(own))), own


def named_again(rows: DataFrame, own: list[str], columns: list[str], **made) -> DataFrame:
    """The columns of the documents in their order; those in `made` are new."""
    back = {c: F.col(f"__own{i}") for i, c in enumerate(own)} | {c: F.col(c) for c in ("doc_id", "text")} | made
    return rows.select(*(back[c].alias(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, own = plain_names(docs)
    scored = toxicity.scored(plain, read_table(spark, sf_dir, "labels"))
    return named_again(scored.where(F.col("toxicity") < toxicity.THRESHOLD), own, docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, own = plain_names(docs)
    text = F.col("kept_text")
    made = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return named_again(line_dedup.line_dedup(plain), own, docs.columns, **made)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_dedup(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.ranks_path(), decoded=True)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("mix_sources", mix_sources), ("bpe", to_tokens)]

#: The learned lexicon, MinHash candidates and BPE merges are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

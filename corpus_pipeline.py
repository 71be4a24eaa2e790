"""From raw documents to token ids: the stages of a training-data pipeline over the table documents.

Each stage works on what the one before kept, written as Parquet in between.
All but the last return the columns of documents. For every stage: an empty
table gives an empty one; texts may be of any length and are judged whole; null
texts, null ids and null sources are named where they matter; columns beside
doc_id, text, source and n_chars are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeloom.llm.common import fresh, stored, table
from nodeloom.llm.lines import deduplicate_lines
from nodeloom.llm.minmax import near_duplicates
from nodeloom.llm.mixing import apply_mix
from nodeloom.llm.queries import bpe_digests
from nodeloom.llm.toxicity import fit, scored

#: Shingles of two words, as the contract of the operator has them: with five, an edit in every ten words already hides a near copy.
SHINGLE_WORDS, PERCENT = 2, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Null and empty texts score low and stay; repeated rows share their score."""
    (score,) = fresh(docs.columns, "score")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, out_col=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier one go, and documents that lose all they had; n_chars follows the text.

    Null texts, and texts that were blank before, stay as they are; equal rows
    don't take lines from each other, the next stage leaves one of them.
    """
    lines, removed = fresh(docs.columns, "n_lines", "n_removed")
    found = deduplicate_lines(docs, lines_col=lines, removed_col=removed)
    found = found.where((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    return found.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links at 0.8 join, the one with the smallest doc_id stays, and of rows under one id the one whose text comes first.

    Texts without words, null ones too, are linked with nothing; rows with a
    null id stay.
    """
    found = near_duplicates(docs.select("doc_id", "text"), words=SHINGLE_WORDS, percent=PERCENT).where("doc_id IS NOT NULL")
    ids = found.groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    ids = stored(ids.where("NOT kept OR n > 1"), "pipeline-ids")
    several = docs.join(ids.where("kept").select("doc_id"), "doc_id", "left_semi")
    (number,) = fresh(docs.columns, "number")
    rest = [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    first = several.withColumn(number, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64(*rest)))).where(F.col(number) == 1)
    return docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source comes to its share of the mix: documents stay whole and are left out, taken once or repeated once. Texts without words, null ones too, are left out; null is a source of its own."""
    return apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, repeated ones too. A null text has no tokens."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

ORACLE_SQL = None  # SQL can express neither the classifier nor the tokenizer; tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

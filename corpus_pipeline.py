"""Documents to training sequences: quality classifier, line dedup, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept. All but the last return the columns of ``documents``. In every stage null
and empty texts and null ids are documents like others (none is a near copy of
another; they pack as a closing id alone), repeated rows are treated alike,
texts of any length are taken whole, an empty table gives an empty one, and
only doc_id, text and n_chars are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoria.llm import line_dedup, mixing, ngram_join, packing, quality_classifier
from mnemoria.llm.common import drop_table, read_table, write_table

#: Shares of tokens, among documents that the earlier stages kept.
TARGETS = {"clean": 0.97, "toxic": 0.03}


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(docs, read_table(spark, sf_dir, "labels"), threshold=0.3)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go; n_chars follows where a text has changed."""
    out = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles, the one with the smallest id stays."""
    return ngram_join.keep_first(docs, k=5, num=80, den=100).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers of copies that bring toxic and clean tokens to their targets."""
    labels = read_table(spark, sf_dir, "labels")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    return mixing.resample(docs, labels.select("doc_id", domain.alias("domain")), TARGETS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 1024, a row for each piece."""
    return packing.pack(docs, window=1024, keep_ids=True)


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_common_lines),
    ("ngram_jaccard_join", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]
#: SQL can't express the classifier, the gradient fit or the subset-sum plan.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes when the next one's is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = write_table(stage(spark, docs, sf_dir), name)
        if before:
            drop_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

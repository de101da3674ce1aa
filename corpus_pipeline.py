"""The corpus pipeline: quality, line dedup, near-dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next stage's documents.  All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import line_dedup, near_dedup, packing, quality
from quire.llm.catalog import BPE_JSON
from quire.llm.common import Scratch, read_table
from quire.runtime import spread

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    labels = read_table(spark, sf_dir, "labels")
    scored = quality.classify(spark, docs, labels, keep_cols=COLUMNS[1:])
    return scored.where("keep").select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines; n_chars follows the text."""
    cut = line_dedup.dedup_lines(spark, docs, keep_cols=("lang", "source"), spare_copies=True)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that five-word shingles of similarity 0.8 link."""
    found = near_dedup.near_duplicates(spark, docs, width=5, percent=80)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens that hold every remaining document."""
    return packing.pack_documents(spark, docs, BPE_JSON, capacity=2048)


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_boilerplate),
    ("minhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack),
]

#: The classifier and the packing aren't expressible in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spread(read_table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

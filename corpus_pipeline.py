"""A corpus pipeline: toxic documents, copies, near copies and benchmark passages go; the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. ``run`` writes each stage's
result as Parquet to the shared folder and reads it again as the next one's documents.

All stages take null and empty texts, texts of any length, rows that repeat a doc_id or have none, and an empty table; columns
other than doc_id and text go through as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from docspark.llm.common import keep
from docspark.llm.queries import PACK_END, tokenizer_path


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that score 0.5 or more; null and empty texts stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each text (white space aside); null and empty texts are one text."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; null, empty and very short texts have no near copies and stay."""
    return jaccard_join.drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that have a window of a benchmark text; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of ``docs`` with its sequence and place; null and empty texts are their end id alone."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path(), PACK_END))


STAGES = [
    ("toxicity", toxic_documents),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", packed_sequences),
]
#: SQL can't express the first, third and last stage; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

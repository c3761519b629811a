"""Chunks, summaries and ordered concatenation of document text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def chunk_documents(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Rows (doc_id, chunk_no, start, chunk): a chunk of ``size`` characters starts every size - overlap.

    Empty and null texts have no chunks; a last chunk that lies wholly in the overlap is kept; a negative overlap
    leaves gaps.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    if size <= 0:
        raise ValueError("size must be positive")
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(size - overlap))
    each = docs.where(F.length("text") > 0).select("doc_id", "text", F.posexplode(starts).alias("chunk_no", "start"))
    return each.select("doc_id", "chunk_no", "start", F.substr("text", F.col("start") + 1, F.lit(size)).alias("chunk"))


def ingest_summary(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Characters of each document, and how many chunks ``chunk_documents`` makes of it; null and empty texts have none of either.

    The number follows from the length, so nothing is exploded or shuffled.
    """
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", n.alias("characters"), F.ceil(n / F.lit(size - overlap)).alias("chunks"))


def ordered_concat(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The texts of each key in order, without a separator; null is empty. Also the number of parts."""
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return parts.groupBy(key).agg(each.alias("all")).select(key, F.array_join(F.transform("all", lambda x: x["t"]), "").alias("content"), F.size("all").cast("long").alias("pages"))


def ingest_report(pages: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """Rows (key, pages, characters, chunks) of documents that come as pages: what ``ordered_concat`` and ``chunk_documents`` would give.

    Counted by sums that are combined before the shuffle; no text is collected, so a document may have any number of pages. Null
    pages are empty, and count as pages.
    """
    chars = F.coalesce(F.length(text), F.lit(0)).cast("long")
    found = pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), F.sum(chars).alias("characters"))
    return found.withColumn("chunks", F.ceil(F.col("characters") / F.lit(size - overlap)))

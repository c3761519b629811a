"""A stored inverted index with the largest weight of each block, and searches that skip blocks. All of it in Spark's own expressions.

Documents are dealt to ranges by a hash. The postings of a term in a range are a block, of which the largest weight is known.
A question's blocks of one range together bound what any document there can score, so a range whose bound is under the k-th
best score known is never opened. Postings are stored by range, in order of terms: a document's are in one file, and a
term's are in few row groups of each.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..kept import keep, small, spread

K1, B = 1.2, 0.75
#: Documents of a range, on average.
RANGE_DOCS = 64
#: Postings for each result that a first look at a question's rarest terms reads, to know a score that the k best reach.
SEED_POSTINGS = 16
#: Scores are compared rounded to 6 decimals.
_CLOSE = 1e-6


class TextIndex(NamedTuple):
    """``postings``: term, range, doc, weight; ``blocks``: term, range, most (the largest weight), n; ``terms``: term, df, most, idf.

    Weights are those without the idf, which is known for each term once all is counted; ``terms.most`` has it.
    """

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def counted_words(docs: DataFrame, item: str) -> DataFrame:
    """Rows (doc, size, terms, tf) of ``docs`` (item, text): its number of words, its distinct ones and how often each stands there.

    A row's words are counted where it is read: words in order, of which each first one is found by the one before.
    """
    words = spread(docs.select(item, "text")).select(F.col(item).cast("long").alias("doc"), F.sort_array(terms(F.col("text"))).alias("w"))
    firsts = words.select("doc", "w", F.expr("filter(transform(w, (x, i) -> IF(i = 0 OR x <> get(w, i - 1), i, -1)), i -> i >= 0)").alias("at"))
    tf = F.expr("transform(at, (i, k) -> coalesce(get(at, k + 1), size(w)) - i)")
    return firsts.select("doc", F.size("w").alias("size"), F.expr("transform(at, i -> get(w, i))").alias("terms"), tf.alias("tf"))


def repeats(docs: DataFrame, item: str) -> bool:
    """Whether rows repeat an id."""
    return not docs.groupBy(F.col(item).cast("long")).count().where("count > 1").isEmpty()


def idf(n: int) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5))"""
    return F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))


def build_index(docs: DataFrame, only: DataFrame | None = None, item: str = "doc_id", range_docs: int = RANGE_DOCS) -> TextIndex:
    """Index of ``docs`` (item, text): Robertson-Zaragoza weights with idf ln(1 + (N - df + 0.5) / (df + 0.5)).

    ``only`` (term) restricts it to some terms; lengths and N are those of whole documents all the same. Rows that
    repeat an id with another length count as one document each for df, as one for scores. Documents are shuffled once, with their words
    in one row; blocks and postings are made where a range has arrived, and stored as one table.
    """
    counts = keep(counted_words(docs, item), "term-counts")
    n, mean = counts.agg(F.count(F.lit(1)), F.avg("size")).first()
    ranges = max(1, -(-n // range_docs))
    dealt = counts.withColumn("range", F.pmod(F.xxhash64("doc"), F.lit(ranges)).cast("int")).repartition("range")
    each = dealt.select("range", "doc", "size", F.explode(F.arrays_zip("terms", "tf")).alias("t")).select("range", "doc", "size", F.col("t.terms").alias("term"), F.col("t.tf").alias("tf"))
    if only is not None:
        each = each.join(small(only.select("term").distinct(), 32), "term", "left_semi")
    if repeats(counts, "doc"):
        each = each.groupBy("range", "term", "doc", "size").agg(F.sum("tf").alias("tf"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean or 1.0)))
    posted = each.select("term", "range", F.struct("doc", weight.alias("weight")).alias("entry"))
    made = posted.groupBy("range", "term").agg(F.max("entry.weight").alias("most"), F.count(F.lit(1)).alias("n"), F.collect_list("entry").alias("entries"))
    stored = keep(made.sortWithinPartitions("term", "range"), "index")
    blocks = stored.select("term", "range", "most", "n")
    postings = stored.select("term", "range", F.inline("entries"))
    known = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most")).withColumn("idf", idf(n))
    return TextIndex(postings, blocks, keep(known.withColumn("most", F.col("most") * F.col("idf")), "index-terms"))


def write_index(index: TextIndex, path: str) -> None:
    """Store ``index`` at ``path`` in the layout it is built in."""
    index.postings.repartition("range").sortWithinPartitions("term", "range").write.parquet(f"{path}/postings")
    for name, table in (("blocks", index.blocks), ("terms", index.terms)):
        table.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "blocks", "terms")))


def _asked(index: TextIndex, questions: DataFrame, query: str) -> DataFrame:
    """Rows (q, term, df, most, idf): the questions' terms that the index has."""
    words = questions.select(F.col(query).cast("long").alias("q"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()
    return words.join(index.terms, "term")


def _scored(index: TextIndex, asked: DataFrame, open_: DataFrame | None = None) -> DataFrame:
    """Rows (q, doc, score) of the postings of ``asked`` (q, term, idf), of the ranges in ``open_`` (q, range) if given.

    A file has all postings of its documents, so sums are whole before they are shuffled, as long as the questions' terms
    are few enough to be broadcast.
    """
    met = index.postings.join(small(asked.select("q", "term", "idf"), 40), "term")
    if open_ is not None:
        met = met.join(small(open_, 16), ["q", "range"])
    return met.groupBy("q", "doc").agg(F.sum(F.col("weight") * F.col("idf")).alias("score"))


def all_scores(index: TextIndex, questions: DataFrame, query: str = "item_id") -> DataFrame:
    """Rows (q, doc, score): every document that has a term of a question."""
    return _scored(index, _asked(index, questions, query))


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows (q, doc, score) of each question, with rank; equal scores (to 6 decimals) by doc."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", 6).desc(), "doc"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def needed_ranges(index: TextIndex, questions: DataFrame, k: int, query: str = "item_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a question's terms, ranges that may hold one of its ``k`` best, all its ranges with their bounds).

    The first look scores the postings of the terms of largest weight alone: sums over some terms are at most the whole
    sums, so the k-th best of them is reached by ``k`` documents.
    """
    by_most = Window.partitionBy("q").orderBy(F.desc("most"), "term").rowsBetween(Window.unboundedPreceding, -1)
    asked = keep(_asked(index, questions, query).withColumn("before", F.coalesce(F.sum("df").over(by_most), F.lit(0))), "asked-terms")
    seeds = asked.where(F.col("before") < k * SEED_POSTINGS).select("q", "term", "idf")
    reached = ranked(_scored(index, seeds), k).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    bounds = asked.select("q", "term", "idf").join(index.blocks.select("term", "range", "most"), "term").groupBy("q", "range").agg(F.sum(F.col("most") * F.col("idf")).alias("bound"))
    told = keep(bounds.join(reached.select("q", "least"), "q", "left"), "range-bounds")
    return asked, told.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - _CLOSE)).select("q", "range"), told


def search(index: TextIndex, questions: DataFrame, k: int, query: str = "item_id", item: str = "doc_id") -> DataFrame:
    """Rows (query, item, score, rank): the ``k`` best documents of each of ``questions`` (query, text), as if all were scored."""
    asked, open_, _ = needed_ranges(index, questions, k, query)
    scores = _scored(index, asked, open_)
    return ranked(scores, k).select(F.col("q").alias(query), F.col("doc").alias(item), "score", "rank")

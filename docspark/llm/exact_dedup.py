"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import keep, row_mark, without

#: A round clears so many bits of a run's number, so up to 2**BITS runs meet in one.
BITS = 4
#: A run of white space that isn't a single space already.
_WHITE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
_KEY = ("text_sha256", "n_bytes", "check")


def normalised(text: Column) -> Column:
    """``text`` with each run of white space (space, U+0009 to U+000D) as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _WHITE, " ")


def digests(docs: DataFrame, text: Column) -> DataFrame:
    """Rows (doc_id, mark, run, text_sha256, n_bytes, check) of ``text``: a row's run is the partition that read it."""
    return docs.select("doc_id", row_mark(F.col("text")).alias("mark"), text.alias("t")).select(
        "doc_id",
        "mark",
        F.spark_partition_id().alias("run"),
        F.sha2("t", 256).alias("text_sha256"),
        F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
    )


def receiver(run: Column, level: int) -> Column:
    """The run that ``run`` is sent to in round ``level``: its number without the bits of that round, as in a binomial tree."""
    return run.bitwiseAND(F.lit(-1 << (BITS * (level + 1)))).cast("int")


def _merged(rows: DataFrame) -> DataFrame:
    """Multiway merge of the runs that meet (rows with one number in ``run``): sorted by digest, the smallest doc_id first, one row a digest.

    A digest stands in a run once, so however common a text is, at most 2**BITS of its rows meet. Rows only merge if
    length and a second hash agree with the digest, which verifies the doc_id that is retained.
    """
    same = Window.partitionBy("run", *_KEY)
    first = F.row_number().over(same.orderBy(F.asc_nulls_last("low")))
    merged = rows.select("run", *_KEY, "low", F.sum("n").over(same).alias("total"), first.alias("place"))
    return merged.where("place = 1").select("run", *_KEY, "low", F.col("total").alias("n"))


def merge_runs(rows: DataFrame, runs: int) -> list[DataFrame]:
    """The levels of the merge tree over ``rows`` (see ``digests``), leaves first.

    A leaf holds, for one run, the smallest doc_id and the number of rows of each digest, in order of the digests. In round r
    the runs whose numbers differ in the r-th BITS bits only are sent to the lowest of them and merged. A run is dealt to
    tasks by digest, so no task receives a whole run. The last level has one run.
    """
    leaf = rows.groupBy("run", *_KEY).agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    levels = [keep(leaf.sortWithinPartitions("run", *_KEY), "digest-run")]
    while runs > 1 << (BITS * (len(levels) - 1)):
        sent = levels[-1].withColumn("run", receiver(F.col("run"), len(levels) - 1))
        levels.append(keep(_merged(sent), "digest-run"))
    return levels


def exact_groups(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, any more columns): doc_id, mark, keep_id, group_size, kept, text_sha256, n_bytes.

    Rows are equal when their normalised texts are, or else the values of ``text``. Of equal rows the one with the smallest doc_id stays. Null and
    empty texts are one group. If rows repeat a doc_id, each counts, and all rows with the keep_id say kept. A null doc_id
    never becomes keep_id unless the whole group has none; then keep_id is null and kept true. An empty table
    gives no rows. Columns other than doc_id and text are ignored, whatever their names.
    The answers go back down the tree: a copy looks its run's row up, so that a text with very many copies is
    spread over as many tasks as runs hold it.
    """
    rows = keep(digests(docs, normalised(F.col("text")) if text is None else text), "digests")
    runs = (rows.agg(F.max("run").alias("m")).first()["m"] or 0) + 1
    levels = merge_runs(rows, runs)
    answer = levels[-1].select("run", *_KEY, F.col("low").alias("keep_id"), F.col("n").alias("group_size"))
    for i, level in reversed([*enumerate(levels[:-1])]):
        own = level.select("run", *_KEY, receiver(F.col("run"), i).alias("up"))
        answer = own.join(answer.withColumnRenamed("run", "up"), ["up", *_KEY]).drop("up")
    return rows.join(answer, ["run", *_KEY]).select(
        "doc_id",
        "mark",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        F.col("n_bytes").cast("long").alias("n_bytes"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: those that ``exact_groups`` says are kept. Rows alike in doc_id and text stay together."""
    return without(docs, exact_groups(docs).where("not kept"))

"""Changes of a table as functions from its rows to its next version's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def insert_conflicts(incoming: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """``incoming`` with an outcome: inserted, or conflict with a key that is there or that came earlier in the batch.

    ``order`` is unique. As in a unique index, null keys never conflict. A key's first row is found by ``min``, which is
    combined before the shuffle, and joined back; adaptive execution may split the rows of a very common key.
    """
    first = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__first"))
    there = existing.select(key, F.lit(True).alias("__there")).distinct()
    asked = incoming.join(first.join(there, key, "left"), key, "left")
    return asked.withColumn("outcome", F.when(F.col("__there") | (F.col(order) > F.col("__first")), "conflict").otherwise("inserted")).select(*incoming.columns, "outcome")


def insert_rows(incoming: DataFrame, existing: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(the table's rows after the insert, the conflicting rows)."""
    judged = insert_conflicts(incoming, existing, key, order)
    good = judged.where("outcome = 'inserted'").drop("outcome")
    return existing.unionByName(good, allowMissingColumns=True), judged.where("outcome = 'conflict'").drop("outcome")


def flag_update(rows: DataFrame, keys: DataFrame, key: str, column: str, value: Column, touched: str | None = None, now: Column | None = None) -> DataFrame:
    """``column`` becomes ``value`` for ``keys``; ``touched`` becomes ``now`` there."""
    hit = rows.join(keys.select(key).distinct().withColumn("hit", F.lit(True)), key, "left")
    out = hit.withColumn(column, F.when(F.col("hit"), value).otherwise(F.col(column)))
    if touched:
        out = out.withColumn(touched, F.when(F.col("hit"), now).otherwise(F.col(touched)))
    return out.drop("hit").select(rows.columns)


def delete_keys(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows that are left, and the keys that weren't there."""
    return rows.join(keys, key, "left_anti"), keys.select(key).distinct().join(rows, key, "left_anti")


def cascade_delete(parent: DataFrame, gone: DataFrame, children: list[tuple[DataFrame, str, str]], key: str) -> list[DataFrame]:
    """Parents without ``gone``; then each (child, own key, key of its parent) without the rows whose parent went."""
    out, keys = [parent.join(gone, key, "left_anti")], gone.select(F.col(key).alias("k"))
    for child, own, up in children:
        doomed = child.join(keys, child[up] == keys["k"], "left_semi")
        out.append(child.join(keys, child[up] == keys["k"], "left_anti"))
        keys = doomed.select(F.col(own).alias("k")).distinct()
    return out


def set_null(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """References to ``gone`` become null."""
    hit = rows.join(gone.select(key).distinct().withColumn("hit", F.lit(True)), key, "left")
    return hit.withColumn(key, F.when(F.col("hit"), F.lit(None)).otherwise(F.col(key))).drop("hit").select(rows.columns)


def backfill(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """A new column, or the nulls of one, filled with ``value``."""
    return rows.withColumn(column, F.coalesce(F.col(column), value) if column in rows.columns else value)


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, nulls) for each of ``columns`` that has nulls: what keeps it from becoming NOT NULL."""
    counts = rows.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns))
    return counts.unpivot([], columns, "column", "nulls").where("nulls > 0")


def relaxed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` may be null from now on, as its schema says."""
    return rows.withColumn(column, F.when(F.col(column).isNotNull(), F.col(column)))


def append_rows(one: DataFrame, two: DataFrame) -> DataFrame:
    """All rows of both by column name; columns that one of them lacks are null there."""
    return one.unionByName(two, allowMissingColumns=True)

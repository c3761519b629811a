"""Repeated, missing and orphaned rows; chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def duplicate_groups(rows: DataFrame, key: Column, member: Column) -> DataFrame:
    """Keys of several rows, with the members' names in order. Members are only collected for keys that repeat."""
    named = rows.select(key.alias("key"), member.alias("member"))
    repeated = named.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and key is not null")
    found = named.join(repeated, "key").groupBy("key").agg(F.max("n").alias("n"), F.array_join(F.array_sort(F.collect_list("member")), ", ").alias("members"))
    return found


def duplicate_content(rows: DataFrame, content: Column, key: str) -> DataFrame:
    """Contents that several rows have: checksum, rows, smallest key. Combined before the shuffle."""
    return rows.groupBy(F.sha2(content, 256).alias("checksum")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).where("n > 1")


def missing_names(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """The distinct rows of ``wanted`` that ``there`` doesn't have; null equals null."""
    return wanted.subtract(there)


def orphans(rows: DataFrame, references: DataFrame, key: str) -> DataFrame:
    return rows.join(references, key, "left_anti")


def chain_integrity(links: DataFrame, group: str, name: str, parent: str) -> DataFrame:
    """Roots and heads of each group's chain of (name, parent); a sound chain has one of each."""
    named = links.select(group, F.col(parent).alias(name)).where(F.col(name).isNotNull()).distinct()
    heads = links.join(named, [group, name], "left_anti").groupBy(group).agg(F.count(F.lit(1)).alias("heads"))
    roots = links.groupBy(group).agg(F.sum(F.when(F.col(parent).isNull(), 1).otherwise(0)).alias("roots"))
    out = roots.join(heads, group, "left").select(group, "roots", F.coalesce("heads", F.lit(0)).alias("heads"))
    return out.withColumn("sound", (F.col("roots") == 1) & (F.col("heads") == 1))

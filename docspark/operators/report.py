"""A report's items, and its lines as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import percent

_NUMBERS = "struct<num_statements:long,missing_lines:long,percent_covered:double>"
REPORT_SCHEMA = f"totals {_NUMBERS}, files map<string,struct<summary:{_NUMBERS}>>"


def _numbers(of: Column) -> list[Column]:
    zero = F.lit(0).cast("long")
    return [
        F.coalesce(of["percent_covered"], F.lit(0.0)).alias("percent"),
        F.coalesce(of["num_statements"], zero).alias("statements"),
        F.coalesce(of["missing_lines"], zero).alias("missing"),
    ]


def report_items(reports: DataFrame) -> DataFrame:
    """Rows (name, percent, statements, missing) of ``reports`` (totals, files): one for each file; absent numbers are 0."""
    each = reports.select(F.explode("files").alias("name", "file"))
    return each.select("name", *_numbers(F.col("file.summary")))


def report_totals(reports: DataFrame) -> DataFrame:
    return reports.select(F.lit("TOTAL").alias("name"), *_numbers(F.col("totals")))


def summary_items(rows: DataFrame) -> DataFrame:
    """Rows (name, percent, statements, missing) of ``rows`` (name and a report's numbers); absent numbers are 0."""
    return rows.select("name", *_numbers(F.struct("percent_covered", "num_statements", "missing_lines")))


def report_rows(totals: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (section, percent, name, line) of the totals (section 0) and the items (section 1), in no order."""
    number = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("| `"), "name", F.lit("` | "), percent(F.col("percent")), F.lit(" | "), number("statements"), F.lit(" | "), number("missing"), F.lit(" |"))
    every = totals.select(F.lit(0).alias("section"), "*").unionByName(items.select(F.lit(1).alias("section"), "*"))
    return every.select("section", "percent", "name", line.alias("line"))


def report_lines(totals: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (section, line), in order: the totals, then the items by ascending percent, equal ones by name."""
    return report_rows(totals, items).orderBy("section", "percent", "name").select("section", "line")

"""New versions of tables: checked while they are written, and written anew only where they changed."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


class CheckFailed(ValueError):
    """A version that doesn't keep its rules; ``metrics`` says what was counted."""

    def __init__(self, metrics: dict[str, int], broken: list[str]):
        super().__init__(", ".join(broken))
        self.metrics, self.broken = metrics, broken


def write_checked(rows: DataFrame, path: str, required: list[str] | None = None, keys: list[str] | None = None, least: int = 0) -> dict[str, int]:
    """Write ``rows`` as a new Parquet table at ``path`` and return what was counted on the way: rows, nulls, distinct estimates.

    The counts are taken by the pass that writes, so nothing is scanned twice. ``required`` columns must have no nulls, and there must be
    ``least`` rows; otherwise CheckFailed is raised and ``path`` is left empty. The version before, at another path, stays
    as it is in either case. ``keys`` only get an estimate of their distinct values (see ``repeated_keys`` for the exact check).
    """
    required, keys = required or [], keys or []
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), *(F.count(F.when(F.col(c).isNull(), 1)).alias(f"nulls:{c}") for c in required), *(F.approx_count_distinct(c).alias(f"distinct:{c}") for c in keys)]
    rows.observe(seen, *counts).write.parquet(path)
    metrics = seen.get
    broken = [f"{metrics[f'nulls:{c}']} nulls in {c}" for c in required if metrics[f"nulls:{c}"]]
    if metrics["rows"] < least:
        broken.append(f"{metrics['rows']} rows, fewer than {least}")
    if broken:
        rows.limit(0).write.mode("overwrite").parquet(path)
        raise CheckFailed(metrics, broken)
    return metrics


class Version(NamedTuple):
    """A table's next version: ``rows`` of all its files; ``rewritten`` of the old files were replaced, ``kept`` are read as they are."""

    rows: DataFrame
    rewritten: list[str]
    kept: list[str]


def touched_files(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows (file): those of ``table``'s files that have a row with one of ``keys``. Only the key column is read."""
    own = table.select(F.col(key), F.col("_metadata.file_path").alias("file"))
    return own.join(keys.select(key).distinct(), key, "left_semi").select("file").distinct()


def rewrite_touched(spark: SparkSession, files: list[str], keys: DataFrame, key: str, change: Callable[[DataFrame], DataFrame], out: str) -> Version:
    """The next version of the Parquet table that ``files`` (or folders) make up, after ``change`` of the rows with one of ``keys``.

    ``change`` maps the rows of some files to their next version (as ``flag_update``, ``delete_keys`` and the like do). It runs on the
    files that have such a row; its result is written to ``out``; all other files are neither read whole nor written. File names
    go through the driver, which lists them anyway.
    """
    table = spark.read.parquet(*files)
    shape = table.schema
    name = lambda f: re.sub("^file:/+", "file:/", f)  # noqa: E731  Spark has two spellings of a local file
    hit = sorted(name(r["file"]) for r in touched_files(table, keys, key).collect())
    kept = sorted({name(f) for f in table.inputFiles()} - set(hit))
    if not hit:
        return Version(table, [], kept)
    change(spark.read.schema(shape).parquet(*hit)).write.parquet(out)
    new = spark.read.schema(shape).parquet(out)
    return Version(spark.read.schema(shape).parquet(*kept).unionByName(new) if kept else new, hit, kept)

"""Plans of several operators: an upload batch, from files to registry and catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import object_address, strip
from ..operators.catalog import register_objects


def ingest_uploads(uploads: DataFrame, payload: Column, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored objects, catalog rows, refused uploads) of judged ``uploads`` (id, drug_name, outcome, ...)."""
    good = uploads.where("outcome = '201'")
    objects = register_objects(good, payload, F.col("id"), "stored_objects", now)
    rows = good.select(F.col("id").cast("string").alias("id"), strip(F.col("drug_name")).alias("drug_name"), object_address("stored_objects", F.col("id")).alias("file_address"), F.lit("pending").alias("status"), now.alias("created_at"), now.alias("updated_at"))
    return objects, rows, uploads.where("outcome <> '201'")

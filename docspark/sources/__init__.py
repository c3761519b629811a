"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import has_magic
from ..operators.report import REPORT_SCHEMA
from ..operators.validate import MAX_BYTES, upload_outcome

LOG_SCHEMA = "event string, level string, timestamp string, correlation_id string, method string, path string, client_ip string, user_id string, status_code int, duration_ms double, app_version string, environment string"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def key_bounds(spark: SparkSession, url: str, table: str, key: str, options: dict[str, str] | None = None) -> tuple[int, int] | None:
    """The least and greatest ``key`` of a database table, found by the database; None if it has no rows with one."""
    own = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    told = spark.read.jdbc(url, f"(SELECT MIN({own}) AS low, MAX({own}) AS high FROM {table}) bounds", properties=options or {}).first()
    return None if told[0] is None else (int(told[0]), int(told[1]))


def read_database(spark: SparkSession, url: str, table: str, key: str, low: int | None = None, high: int | None = None, partitions: int = 8, options: dict[str, str] | None = None) -> DataFrame:
    """A table over JDBC, read in parallel by ranges of an integer key, between bounds that are found if they aren't given.

    Bounds only deal the rows out: those beyond them, and without a key, are read too. Filters, columns, limits and sums of a query that
    the database can do are pushed to it. ``partitions`` is also how many connections are open at once. ``options``: of the reader, such as
    driver, user, fetchsize.
    """
    if low is None or high is None:
        found = key_bounds(spark, url, table, key, options)
        if found is None:
            return spark.read.jdbc(url, table, properties=options or {})
        low, high = found
    own = {"pushDownLimit": "true", "pushDownAggregate": "true", **(options or {})}
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high + 1, numPartitions=partitions, properties=own)


def write_database(rows: DataFrame, url: str, table: str, options: dict[str, str] | None = None) -> None:
    """Append ``rows`` to a database table, which is made if it isn't there."""
    rows.write.jdbc(url, table, mode="append", properties=options or {})


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def write_logs(rows: DataFrame, path: str) -> None:
    write_lines(rows.select(F.to_json(F.struct("*")).alias("value")), path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Append a one-column frame of text, in its order."""
    lines.write.mode("append").text(path)


def append_table(rows: DataFrame, path: str) -> None:
    """Append ``rows`` to the Parquet table at ``path``: the sink of objects, catalog rows, users and tokens."""
    rows.write.mode("append").parquet(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).json(path, multiLine=True)


FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def judged_uploads(manifest: DataFrame, sizes: DataFrame, heads: DataFrame, magic: bytes = b"%PDF-") -> DataFrame:
    """``manifest`` (path, drug_name, content_type, has_file) with size and outcome. ``sizes``: path, size; ``heads``: path, content."""
    known = heads.select("path", has_magic(F.col("content"), magic).alias("__magic"))
    joined = manifest.join(sizes, "path", "left").join(known, "path", "left")
    outcome = upload_outcome(F.col("drug_name"), F.col("has_file"), F.col("content_type"), F.col("size"), F.col("__magic"))
    return joined.withColumn("outcome", outcome).drop("__magic")


def _named(files: DataFrame, *columns: Column) -> DataFrame:
    return files.select(F.element_at(F.split("path", "/"), -1).alias("path"), *columns)


def read_uploads(spark: SparkSession, files: str, manifest: DataFrame) -> DataFrame:
    """Uploads of a manifest, judged by size and first bytes.

    The file reader leaves empty files out, so the manifest says which files there are; one without a row is empty.
    Sizes come from the listing alone; only the content of files within the limit is opened.
    """
    found = spark.read.format("binaryFile").load(files)
    return judged_uploads(manifest, _named(found, F.col("length").alias("size")), _named(found.where(F.col("length") <= MAX_BYTES), F.col("content")))


def stream_uploads(spark: SparkSession, files: str, manifest: DataFrame) -> DataFrame:
    """A stream of the files that arrive in a folder, with what ``manifest`` says of them, size, outcome and, if accepted, status pending.

    A file that isn't in ``manifest`` comes out as unlisted. Of files over the limit only the listing is read. Empty files, and rows that come
    later than their file, need a manifest that is a stream too: see ``streaming.uploads``.
    """
    found = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(files)
    opened = _named(found.where(F.col("length") <= MAX_BYTES), F.col("length").alias("size"), has_magic(F.col("content"), b"%PDF-").alias("__magic"))
    listed = _named(found.where(F.col("length") > MAX_BYTES), F.col("length").alias("size"), F.lit(None).cast("boolean").alias("__magic"))
    own = opened.unionByName(listed).join(manifest.withColumn("__listed", F.lit(True)), "path", "left")
    outcome = upload_outcome(F.col("drug_name"), F.col("has_file"), F.col("content_type"), F.col("size"), F.col("__magic"))
    judged = own.withColumn("outcome", F.when(F.col("__listed"), outcome).otherwise("404 unlisted")).drop("__magic", "__listed")
    return judged.withColumn("status", F.when(F.col("outcome") == "201", "pending"))


def append_stream(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that appends what has arrived to the Parquet table at ``path`` and then ends."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

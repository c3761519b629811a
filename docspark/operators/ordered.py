"""Numbers and carried values in an order, for tables and groups that are too large for one task.

Rows are sorted into ranges, each a task's. What a range needs from those before it (how many rows, the last value) is a row
for each range, summed up on its own and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..kept import keep

_PART, _AT = "__part", "__at"


def _ranges(rows: DataFrame, order: list[str], ranges: int | None) -> DataFrame:
    """``rows`` sorted by ``order`` in ranges, with the number of the range and the place in the whole file order, as a table."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return keep(dealt.withColumns({_AT: F.monotonically_increasing_id(), _PART: F.spark_partition_id()}), "ranges")


def numbered(rows: DataFrame, order: list[str], name: str = "place", ranges: int | None = None) -> DataFrame:
    """``rows`` with their place (from 0) in ``order``, which should tell rows apart (equal ones are numbered in any order).

    No exchange brings rows to one task: each range is numbered by itself, and the counts of ranges (a row each, so at most the number of
    shuffle partitions) say where it begins.
    """
    sorted_ = _ranges(rows, order, ranges)
    counts = sorted_.groupBy(_PART).agg(F.count(F.lit(1)).alias("n"), F.min(_AT).alias("first")).collect()
    begin, told = 0, []
    for r in sorted(counts, key=lambda r: r[_PART]):
        told.append((r[_PART], begin - r["first"]))
        begin += r["n"]
    shift = _rows(rows.sparkSession, told, f"{_PART} int, __shift long")
    return sorted_.join(F.broadcast(shift), _PART).withColumn(name, F.col(_AT) + F.col("__shift")).select(*rows.columns, name)


def _rows(spark: SparkSession, data: list[tuple], shape: str) -> DataFrame:
    return spark.createDataFrame(data, shape)


def carried(rows: DataFrame, group: str, order: list[str], column: str, ranges: int | None = None) -> DataFrame:
    """``rows`` whose ``column`` is filled with the last value that isn't null in the same ``group`` up to the row, in ``order``.

    A group may hold any share of the rows: it is cut into ranges of the order, filled by themselves; the last value of each
    range of a group is carried over the following ones and joined back. Null groups are one group.
    """
    sorted_ = _ranges(rows, [group, *order], ranges)
    within = Window.partitionBy(group, _PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = sorted_.withColumn("__own", F.last(column, ignorenulls=True).over(within))
    has = F.col(column).isNotNull()
    last = sorted_.groupBy(group, _PART).agg(F.max_by(F.when(has, F.col(column)), F.when(has, F.col(_AT))).alias("__last"))
    before = Window.partitionBy(group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carry = last.select(F.col(group).alias("__group"), F.col(_PART).alias("__of"), F.last("__last", ignorenulls=True).over(before).alias("__carry")).where("__carry is not null")
    joined = filled.join(carry, filled[group].eqNullSafe(carry["__group"]) & (filled[_PART] == carry["__of"]), "left")
    return joined.withColumn(column, F.coalesce("__own", "__carry")).select(*rows.columns)

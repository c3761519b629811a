"""Streaming forms: rate limits, single-use tokens and logs."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import new_id
from ..operators.session import valid_at
from ..sources import LOG_SCHEMA


def rate_limit(events: DataFrame, keys: list[str], at: str, tie: str, window: str = "1 minute", most: int = 5) -> DataFrame:
    """``events`` with allowed: the first ``most`` of a key in each epoch-aligned window. (``at``, ``tie``) is unique for a key.

    Spark cuts the ranking to ``most`` rows a key before it shuffles them; the last of these is the key's threshold.
    """
    timed = events.withColumn("__w", F.window(F.col(at).cast("timestamp"), window)["start"])
    order = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"))
    rank = F.row_number().over(Window.partitionBy(*keys, "__w").orderBy(at, tie))
    named = {k: f"__{i}" for i, k in enumerate([*keys, "__w"])}
    first = timed.select(*(F.col(k).alias(n) for k, n in named.items()), order.alias("__at"), rank.alias("__r")).where(F.col("__r") <= most)
    last = first.groupBy(*named.values()).agg(F.max("__at").alias("__last"))
    same = [timed[k].eqNullSafe(last[n]) for k, n in named.items()]
    joined = timed.join(last, functools.reduce(lambda a, b: a & b, same), "left")
    return joined.withColumn("allowed", order <= F.col("__last")).select(*events.columns, "allowed")


def window_counts(stream: DataFrame, keys: list[str], at: str, window: str, late: str = "10 minutes") -> DataFrame:
    """Counts per key and window of a stream; rows later than ``late`` are left out. Timestamps need a zone."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(*keys, F.window(at, window).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def first_use(stream: DataFrame, token: str, at: str, late: str = "10 minutes", revoked: str | None = None, expires_at: str | None = None) -> DataFrame:
    """The first valid attempt of each token of a stream, among attempts within ``late`` of each other.

    Attempts on a revoked or expired token are left out before, so that they can't use the token up.
    """
    if revoked and expires_at:
        stream = stream.where(valid_at(F.col(revoked), F.col(expires_at), F.col(at)))
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([token])


def single_use_stream(stream: DataFrame, token: str, at: str, tie: str, revoked: str, expires_at: str, late: str = "10 minutes") -> DataFrame:
    """All attempts of a stream with won: the first valid one of each token, in order of arrival and, in a batch, of time.

    A used token is remembered until the watermark has passed its expiry, after which no attempt can be valid.
    """
    timed = stream.withColumns({c: F.col(c).cast("timestamp") for c in (at, expires_at)}).withWatermark(at, late)

    def judge(_key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values([at, tie], ignore_index=True)
        good = rows[revoked].eq(False) & (rows[expires_at] > rows[at])
        won = pd.Series(False, index=rows.index)
        if good.any() and not state.exists:
            won[good.idxmax()] = True
            state.update((True,))
            until = int(rows.loc[won, expires_at].iloc[0].timestamp() * 1000)
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(won=won)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in timed.schema)
    return timed.groupBy(token).applyInPandasWithState(judge, f"{shape}, won boolean", "used boolean", "append", GroupStateTimeout.EventTimeTimeout)


def parse_logs(lines: DataFrame, version: str, environment: str) -> DataFrame:
    """JSON lines (value) as columns, with the constants added; a request without an id gets a new one."""
    rows = lines.select(F.from_json("value", LOG_SCHEMA).alias("r")).select("r.*")
    given = F.nullif(F.col("correlation_id"), F.lit(""))
    return rows.withColumns({"correlation_id": F.coalesce(given, new_id()), "app_version": F.lit(version), "environment": F.lit(environment)})


def context_fill(rows: DataFrame, request: str, at: str, tie: str, column: str) -> DataFrame:
    """``column`` as last bound earlier in the same request."""
    before = Window.partitionBy(request).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(before))

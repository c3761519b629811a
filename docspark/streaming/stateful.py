"""Operators with a state for each key, on Spark's RocksDB state store: rate limits and single-use tokens, event by event."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType

from ..operators.session import valid_at

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Parts that keys are dealt to, each with one state. Fixed for the life of a checkpoint.
PARTS = 4096


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that are started from here on keep their state in RocksDB, which these operators need."""
    if not spark.conf.get(_PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKS)


def _shape(frame: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields) + f", {more}"


def _in_order(rows: Iterator[pd.DataFrame], names: list[str], order: list[str]) -> pd.DataFrame:
    """The rows of a key in this batch, under their ``names`` (Spark gives others to those that begin with an underscore)."""
    return pd.concat(list(rows), ignore_index=True).set_axis(names, axis=1).sort_values(order, ignore_index=True)


def _next_timer(handle: StatefulProcessorHandle, new: int, held: pd.Series, watermark: int) -> None:
    """A timer at the earliest end only: one that fires drops all that has ended and sets the next one."""
    if not len(held) or new < held.min():
        handle.registerTimer(max(new, watermark + 1))


class _Held(StatefulProcessor):
    """State: a list of rows with the time ``until`` which each is needed."""

    name, shape, columns = "", "", ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState(self.name, self.shape)

    def held(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in self.state.get()], columns=[*self.columns])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark, at = timerValues.getCurrentWatermarkInMs(), self.columns.index("until")
        ended = max(expiredTimerInfo.getExpiryTimeInMs(), watermark)
        left = [r for r in map(tuple, self.state.get()) if r[at] > ended]
        if left:
            self.state.put(left)
            self.handle.registerTimer(min(r[at] for r in left))
        else:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _RateLimit(_Held):
    """State: how many events of a key were allowed, at most ``most`` rows for each of its windows that can still get events."""

    name, shape, columns = "allowed", "of string, until long, n long", ("of", "until", "n")

    def __init__(self, names: list[str], order: list[str], most: int):
        self.names, self.order, self.most = names, order, most

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame, held, of = _in_order(rows, self.names, self.order), self.held(), ["of", "until"]
        told = frame["__until"].notna()
        timed = pd.DataFrame({"of": frame.loc[told, "__of"], "until": frame.loc[told, "__until"].astype("int64")})
        number = timed.groupby(of, sort=False).cumcount()
        if len(held):
            before = held.groupby(of, as_index=False)["n"].sum()
            number += timed.merge(before, how="left", on=of)["n"].fillna(0).astype("int64").to_numpy()
        new = timed[number < self.most].groupby(of, sort=False).size()
        if len(new):
            new = new.reset_index(name="n")
            self.state.appendList(list(zip(*(new[c].tolist() for c in self.columns), strict=True)))
            _next_timer(self.handle, int(new["until"].min()), held["until"], timerValues.getCurrentWatermarkInMs())
        good = (number < self.most).reindex(frame.index, fill_value=False)
        yield frame[[c for c in self.names if not c.startswith("__")]].assign(allowed=good.astype(bool))


def rate_limit_stream(stream: DataFrame, keys: list[str], at: str, tie: str, window: str = "1 minute", most: int = 5, late: str = "10 minutes", parts: int | None = None) -> DataFrame:
    """Each event of a stream with allowed: whether it is among the first ``most`` of its keys in its epoch-aligned window.

    The verdict comes with the event (append mode): first come in order of batches, in a batch of (``at``, ``tie``). So on events that
    arrive in order it equals ``rate_limit``. Events later than ``late`` are dropped, by the watermark; those without a time are
    refused. A window's state goes when the watermark has passed its end. Rows of a key in one batch meet in one task: bound the
    batch at its source (``maxFilesPerTrigger``) where a key may be very common.

    With ``parts``, keys are dealt to so many parts by their hash, and a part has one state, read and judged as a whole: where keys are
    many, a call, a state and timers for each of them are what takes the time. The number belongs to a checkpoint.
    """
    use_rocksdb(stream.sparkSession)
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    shape = _shape(timed, "allowed boolean")
    marked = timed.withColumns({"__until": F.unix_millis(F.window(at, window)["end"]), "__of": F.to_json(F.struct(*keys))})
    if parts:
        marked, keys = marked.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(parts))), ["__part"]
    return marked.groupBy(*keys).transformWithStateInPandas(_RateLimit(marked.columns, [at, tie], most), shape, "append", "eventTime")


class _SingleUse(_Held):
    """State: the used tokens of a part, until the watermark passes their expiry."""

    name, columns = "used", ("token", "until")

    def __init__(self, names: list[str], order: list[str], token: str):
        self.names, self.order, self.shape = names, order, f"`{token}` string, until long"

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame, held = _in_order(rows, self.names, self.order), self.held()
        first = frame[frame["__good"].eq(True)].drop_duplicates("__token")
        first = first[~first["__token"].isin(held["token"])]
        if len(first):
            until = first["__until"].astype("int64")
            tokens = [None if pd.isna(x) else x for x in first["__token"]]
            self.state.appendList(list(zip(tokens, until.tolist(), strict=True)))
            _next_timer(self.handle, int(until.min()), held["until"], timerValues.getCurrentWatermarkInMs())
        yield frame[[c for c in self.names if not c.startswith("__")]].assign(won=frame.index.isin(first.index))


def token_use_stream(stream: DataFrame, token: str, at: str, tie: str, revoked: str, expires_at: str, late: str = "10 minutes", parts: int = PARTS) -> DataFrame:
    """All attempts of a stream with won: the first valid one of each token, in order of batches and, in a batch, of (``at``, ``tie``).

    A used token is remembered until the watermark passes its expiry, after which no attempt on it can be valid; its state is
    then cleared by a timer (time-to-live of Spark's state counts processing time, which would let a replay win twice).
    The state can be read by ``token_state``. Tokens are dealt to ``parts`` by their hash, and a part has one state, read and judged as a
    whole; the number belongs to a checkpoint.
    """
    use_rocksdb(stream.sparkSession)
    timed = stream.withColumns({c: F.col(c).cast("timestamp") for c in (at, expires_at)}).withWatermark(at, late)
    shape = _shape(timed, "won boolean")
    binary = timed.schema[token].dataType == BinaryType()
    marked = timed.withColumns(
        {
            "__good": valid_at(F.col(revoked), F.col(expires_at), F.col(at)),
            "__until": F.unix_millis(expires_at),
            "__token": F.base64(token) if binary else F.col(token).cast("string"),
            "__part": F.pmod(F.xxhash64(token), F.lit(parts)),
        }
    )
    return marked.groupBy("__part").transformWithStateInPandas(_SingleUse(marked.columns, [at, tie], token), shape, "append", "eventTime")


def token_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The tokens that a ``token_use_stream`` with this checkpoint remembers as used: rows (key, value, partition_id); tokens are strings
    there, binary ones in base 64."""
    use_rocksdb(spark)
    rows = spark.read.format("statestore").option("stateVarName", "used").load(checkpoint)
    token = rows.schema["list_element"].dataType.names[0]
    return rows.select(F.struct(F.col(f"list_element.`{token}`").alias(token)).alias("key"), F.struct("list_element.until").alias("value"), "partition_id")

"""Streams with state, across batches and restarts: each ``ran`` starts the query anew from its checkpoint."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docspark import sources
from docspark.streaming import rate_limit
from docspark.streaming.stateful import rate_limit_stream, token_state, token_use_stream

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A state store for each partition is opened in each run; two show as much as more."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")



def at(minutes, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


def ran(stream, folder, name="out"):
    sources.append_stream(stream, f"{folder}/{name}", f"{folder}/{name}-cp").awaitTermination(180)
    return stream.sparkSession.read.parquet(f"{folder}/{name}")


def feed(spark, rows, shape, folder):
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(shape).parquet(f"{folder}/in")


EVENTS = "id int, client string, route string, at timestamp"


def test_sixth_event_is_refused(spark, tmp_path):
    batches = [
        [(i, "a", "login", at(0, i)) for i in range(3)] + [(90, "b", "login", at(0, 1)), (95, None, "login", at(0, 2))],
        [(i, "a", "login", at(0, i)) for i in range(3, 7)] + [(91, "b", "register", at(0, 5))],
        [(i, "a", "login", at(1, i)) for i in range(10, 17)] + [(92, "a", "register", at(0, 30))],
        [(20, "a", "login", at(30)), (21, "a", "login", None)],
    ]
    for rows in batches:
        got = ran(rate_limit_stream(feed(spark, rows, EVENTS, tmp_path), ["client", "route"], "at", "id"), tmp_path)
    assert {r.id for r in got.where("not allowed").collect()} - {21} == {5, 6, 15, 16}
    every = spark.read.parquet(f"{tmp_path}/in").where("at is not null")
    want = {(r.id, r.allowed) for r in rate_limit(every, ["client", "route"], "at", "id").collect()}
    assert {(r.id, r.allowed) for r in got.where("at is not null").collect()} == want
    # a row behind the watermark (20 minutes by now) doesn't come out
    late = [(200, "a", "login", at(1)), (201, "a", "login", at(31))]
    got = ran(rate_limit_stream(feed(spark, late, EVENTS, tmp_path), ["client", "route"], "at", "id"), tmp_path)
    assert {r.id for r in got.where("id >= 200").collect()} == {201}


def test_state_of_ended_windows_goes(spark, tmp_path):
    for rows in ([(1, "a", "x", at(0)), (2, "b", "x", at(0))], [(3, "c", "x", at(60))], [(4, "c", "x", at(61))]):
        ran(rate_limit_stream(feed(spark, rows, EVENTS, tmp_path), ["client", "route"], "at", "id"), tmp_path)
    left = spark.read.format("statestore").option("stateVarName", "allowed").load(f"{tmp_path}/out-cp")
    assert {r.key.client for r in left.collect()} == {"c"}


TOKENS = "id int, token string, at timestamp, revoked boolean, until timestamp"


def test_tokens_are_used_once_and_forgotten(spark, tmp_path):
    batches = [
        [(1, "a", at(1), True, at(9)), (2, "a", at(2), False, at(9)), (3, "b", at(3), False, at(3)), (4, "a", at(2), False, at(9))],
        [(5, "a", at(4), False, at(9)), (6, "b", at(2), False, at(3)), (7, "c", at(4), None, None), (8, None, at(4), False, at(9))],
    ]
    read = lambda rows: token_use_stream(feed(spark, rows, TOKENS, tmp_path), "token", "at", "id", "revoked", "until")
    for rows, won in zip(batches, ({2}, {2, 6, 8}), strict=True):
        got = ran(read(rows), tmp_path)
        assert {r.id for r in got.where("won").collect()} == won
    assert got.count() == 8
    assert {r.key.token for r in token_state(spark, f"{tmp_path}/out-cp").collect()} == {"a", "b", None}
    ran(read([(9, "d", at(40), False, at(200))]), tmp_path)  # the watermark passes all other expiries
    got = ran(read([(10, "d", at(41), False, at(200)), (11, "a", at(5), False, at(9))]), tmp_path)
    assert {r.id for r in got.where("id >= 9").collect()} == {9, 10} and {r.id for r in got.where("won and id >= 9").collect()} == {9}
    assert {r.key.token for r in token_state(spark, f"{tmp_path}/out-cp").collect()} == {"d"}
    ran(read([(12, "e", at(400), True, at(500))]), tmp_path)
    ran(read([(13, "e", at(401), True, at(500))]), tmp_path)
    assert token_state(spark, f"{tmp_path}/out-cp").count() == 0


def test_token_stream_equals_the_batch(spark, tmp_path):
    from docspark.operators.session import single_use

    rows = [(i, f"t{i % 7}", at(0, i), i % 5 == 0, at(0, 60 if i % 3 else 20)) for i in range(80)]
    for part in range(0, 80, 27):
        got = ran(token_use_stream(feed(spark, rows[part : part + 27], TOKENS, tmp_path), "token", "at", "id", "revoked", "until"), tmp_path)
    batch = single_use(spark.createDataFrame(rows, TOKENS), "token", "at", "id", "revoked", "until")
    assert {(r.id, r.won) for r in got.select("id", "won").collect()} == {(r.id, r.won) for r in batch.select("id", "won").collect()}
    assert got.where(F.col("won")).count() == batch.where("won").count() > 0


def test_many_keys_take_few_calls(spark, tmp_path):
    """Keys share the call, the state and the timer of their part: verdicts are those of the batch form, and all state goes in the end."""
    rows = [(i, f"k{i % 50}" if i % 50 else None, "x", at(i // 400, i % 60)) for i in range(1600)]
    for part in range(0, 1600, 400):
        got = ran(rate_limit_stream(feed(spark, rows[part : part + 400], EVENTS, tmp_path), ["client"], "at", "id", most=3, parts=2), tmp_path)
    want = {(r.id, r.allowed) for r in rate_limit(spark.createDataFrame(rows, EVENTS), ["client"], "at", "id", most=3).collect()}
    assert {(r.id, r.allowed) for r in got.collect()} == want
    left = lambda: spark.read.format("statestore").option("stateVarName", "allowed").load(f"{tmp_path}/out-cp")
    assert left().select("key").distinct().count() == 2
    for k in (300, 301):
        ran(rate_limit_stream(feed(spark, [(2000 + k, "z", "x", at(k))], EVENTS, tmp_path), ["client"], "at", "id", most=3, parts=2), tmp_path)
    assert {r.list_element.of for r in left().collect()} == {'{"client":"z"}'}


def test_tokens_share_the_state_of_a_part(spark, tmp_path):
    rows = [(i, None if i % 40 == 7 else f"t{i % 40}", at(0, i), i < 40 and i % 2 == 0, at(5 + i % 40)) for i in range(120)]
    for part in range(0, 120, 60):
        got = ran(token_use_stream(feed(spark, rows[part : part + 60], TOKENS, tmp_path), "token", "at", "id", "revoked", "until", parts=2), tmp_path)
    assert got.count() == 120 and {r.id for r in got.where("won").collect()} == {i + 40 * (i % 2 == 0) for i in range(40)}
    held = spark.read.format("statestore").option("stateVarName", "used").load(f"{tmp_path}/out-cp")
    assert held.count() == token_state(spark, f"{tmp_path}/out-cp").count() == 40 and held.select("key").distinct().count() <= 2

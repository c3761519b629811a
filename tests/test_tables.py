"""Ordered scans, checked and partial rewrites, databases, and small rules."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from docspark import functions, sources
from docspark.operators import catalog, checked, mutate, ordered, session, text, validate
from docspark.streaming import context_fill, parse_logs


def test_numbers_without_a_single_task(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), i) for i in range(500)]
    rng.shuffle(rows)
    got = ordered.numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), ["a", "b"], ranges=6)
    assert [(r.a, r.b) for r in sorted(got.collect(), key=lambda r: r.place)] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(r.place for r in got.collect()) == list(range(500))
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    assert ordered.numbered(spark.createDataFrame([], "a int"), ["a"]).count() == 0


@pytest.mark.parametrize("keys", [["x"], ["x", "y", None]])
def test_values_carried_over_ranges(spark, keys):
    rng = random.Random(2)
    rows = [(rng.choice(keys), i // 3, i, rng.choice([None, None, None, i])) for i in range(600)]
    frame = spark.createDataFrame(rows, "k string, at int, tie int, bound int").repartition(4)
    got = ordered.carried(frame, "k", ["at", "tie"], "bound", ranges=7)
    want = {tuple(r) for r in context_fill(frame, "k", "at", "tie", "bound").collect()}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 600
    # one key's rows are dealt to several tasks
    assert ordered._ranges(frame.where("k = 'x'"), ["k", "at", "tie"], 7).select("__part").distinct().count() > 3


def test_checks_ride_on_the_write(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "id int, v string")
    told = checked.write_checked(rows, f"{tmp_path}/one", required=["id"], keys=["id"], least=3)
    assert told == {"rows": 3, "nulls:id": 0, "distinct:id": 2} and spark.read.parquet(f"{tmp_path}/one").count() == 3
    with pytest.raises(checked.CheckFailed, match="1 nulls in v") as failed:
        checked.write_checked(rows, f"{tmp_path}/two", required=["id", "v"])
    assert failed.value.metrics["rows"] == 3 and spark.read.parquet(f"{tmp_path}/two").count() == 0
    assert spark.read.parquet(f"{tmp_path}/one").count() == 3
    with pytest.raises(checked.CheckFailed, match="fewer than 4"):
        checked.write_checked(rows, f"{tmp_path}/three", least=4)


def test_only_touched_files_are_written(spark, tmp_path):
    spark.range(100).select("id", F.lit("pending").alias("status")).repartitionByRange(5, "id").write.parquet(f"{tmp_path}/v1")
    before = {f: os.stat(tmp_path / "v1" / f).st_mtime_ns for f in os.listdir(tmp_path / "v1")}
    keys = spark.createDataFrame([(3,), (4,), (777,)], "id long")
    change = lambda rows: mutate.flag_update(rows, keys, "id", "status", F.lit("ready"))
    two = checked.rewrite_touched(spark, [f"{tmp_path}/v1"], keys, "id", change, f"{tmp_path}/v2")
    assert len(two.rewritten) == 1 and len(two.kept) == 4
    assert {(r.id, r.status) for r in two.rows.collect()} == {(i, "ready" if i in (3, 4) else "pending") for i in range(100)}
    gone = spark.createDataFrame([(99,)], "id long")
    three = checked.rewrite_touched(spark, [*two.kept, f"{tmp_path}/v2"], gone, "id", lambda rows: mutate.delete_keys(rows, gone, "id")[0], f"{tmp_path}/v3")
    assert three.rows.count() == 99 and len(three.rewritten) == 1
    none = checked.rewrite_touched(spark, [f"{tmp_path}/v1"], keys.where("id = 777"), "id", change, f"{tmp_path}/v4")
    assert none.rewritten == [] and none.rows.count() == 100 and not (tmp_path / "v4").exists()
    assert {f: os.stat(tmp_path / "v1" / f).st_mtime_ns for f in os.listdir(tmp_path / "v1")} == before


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(i, f"name {i}", None if i % 5 == 0 else float(i)) for i in range(3, 60)]
    sources.write_database(spark.createDataFrame(rows, "id int, name string, v double"), url, "items", DERBY)
    assert sources.key_bounds(spark, url, "items", "id", DERBY) == (3, 59)
    table = sources.read_database(spark, url, "items", "id", partitions=4, options=DERBY)
    assert {tuple(r) for r in table.collect()} == set(rows)
    assert table.select(F.spark_partition_id()).distinct().count() == 4
    asked = table.where("id > 50 and v is not null").select("name")
    plan = asked._jdf.queryExecution().toString()
    assert "GreaterThan(id,50)" in plan.replace("ID", "id") and "PushedFilters" in plan
    assert {r.name for r in asked.collect()} == {f"name {i}" for i in range(51, 60) if i % 5}
    sources.write_database(spark.createDataFrame([], "id int, v double"), url, "nothing", DERBY)
    assert sources.read_database(spark, url, "nothing", "id", options=DERBY).count() == 0


@pytest.mark.parametrize("x,outside", [("user", False), ("USER", True), (None, True), ("admin", True)])
def test_domains_are_exact(spark, x, outside):
    frame = spark.createDataFrame([(x,)], "x string")
    assert frame.select(validate.outside_domain(F.col("x"), ["user", "Reviewer"]).alias("o")).first().o is outside
    assert frame.select(functions.enum_value(F.col("x")).alias("v")).first().v == (x and x.lower())


def test_missing_text_breaks_a_rule(spark):
    got = spark.createDataFrame([(None,), ("",)], "x string").select(validate.text_violations(F.col("x")).alias("v")).collect()
    assert got[0].v == ["missing"] and got[1].v[0] == "too_short"


@pytest.mark.parametrize("x,two,share", [(1234.5, 1234.5, "1234.5%"), (1e9, 1e9, "1000000000.0%"), (float("inf"), float("inf"), None), (float("-inf"), float("-inf"), None), (None, None, None), (-1234.565, round(-1234.565, 2), f"{-1234.565:.1f}%")])
def test_large_and_infinite_numbers(spark, x, two, share):
    got = spark.createDataFrame([(x,)], "x double").select(functions.rounded(F.col("x")).alias("r"), functions.percent(F.col("x")).alias("p")).first()
    assert got.r == two and (share is None or got.p == share)
    assert spark.createDataFrame([(float("nan"),)], "x double").select(functions.rounded(F.col("x")).alias("r")).first().r != 0


def test_metadata_leaves_the_payload(spark, tmp_path):
    spark.createDataFrame([("a", 5, "x.pdf", b"12345"), ("b", 1, None, b"1")], "object_address string, content_size_bytes int, original_filename string, data binary").write.parquet(f"{tmp_path}/objects")
    registry, keys = spark.read.parquet(f"{tmp_path}/objects"), spark.createDataFrame([("a",), ("z",), ("a",)], "object_address string")
    got = catalog.metadata(keys, registry, "object_address", ["content_size_bytes", "original_filename"])
    assert {tuple(r) for r in got.collect()} == {("a", 5, "x.pdf", True), ("z", None, None, False)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "data#" not in plan


def test_pages_in_the_summary(spark):
    pages = spark.createDataFrame([(1, 0, "x" * 300), (1, 1, None), (1, 2, "y" * 151), (2, 0, None)], "doc int, page int, t string")
    got = {tuple(r) for r in text.ingest_report(pages, "doc", "t").collect()}
    assert got == {(1, 3, 451, 2), (2, 1, 0, 0)}
    whole = text.ordered_concat(pages, "doc", "page", "t").select(F.col("doc").alias("doc_id"), F.col("content").alias("text"))
    assert {(r.doc_id, r.chunks) for r in text.ingest_summary(whole).collect()} == {(r[0], r[3]) for r in got}


def test_new_tokens_in_any_time_zone(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    users = spark.createDataFrame([(1, "raw"), (None, "x"), (2, None)], "user int, secret string")
    got = session.issue(users, "user", F.col("secret"), now).collect()
    assert [(r.user_id, r.expires_at, r.revoked) for r in got] == [(1, dt.datetime(2024, 1, 31), False)] and "raw" not in str(got)
    attempts = spark.createDataFrame([("t", dt.datetime(2024, 1, 1, tzinfo=dt.UTC))], "token string, at timestamp").withColumn("won", F.lit(True))
    first = session.rotate(attempts, "token", "at").first().token
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert session.rotate(attempts, "token", "at").first().token == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_log_stream(spark, tmp_path):
    lines = ['{"event": "login", "correlation_id": "", "status_code": 200, "duration_ms": 1.5}', '{"event": "out", "correlation_id": "c-1"}', "not json"]
    stream = lambda: parse_logs(spark.readStream.text(f"{tmp_path}/in"), "1.2", "test")
    for i, part in enumerate((lines[:2], lines[2:])):
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/in")
        sources.append_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
        got = spark.read.parquet(f"{tmp_path}/out").collect()
        assert len(got) == (2, 3)[i]
    by = {r.event: r for r in got}
    assert by["out"].correlation_id == "c-1" and len(by["login"].correlation_id) == 36 and by["login"].duration_ms == 1.5
    assert by[None].environment == "test" and len({r.correlation_id for r in got}) == 3

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark import functions, plans, sources
from docspark.operators import catalog, mutate, report, retrieval, session, text, validate
from docspark.sources import read_uploads
from docspark.streaming import first_use, parse_logs, rate_limit, single_use_stream, window_counts


@pytest.mark.parametrize("n,chunks,last", [(0, 0, None), (1, 1, 1), (450, 1, 450), (451, 2, 1), (500, 2, 50), (501, 2, 51), (900, 2, 450), (901, 3, 1)])
def test_chunks(spark, n, chunks, last):
    rows = text.chunk_documents(spark.createDataFrame([(1, "x" * n), (2, None)], "doc_id int, text string")).orderBy("chunk_no").collect()
    whole = "x" * n
    assert [r.chunk for r in rows] == [whole[i : i + 500] for i in range(0, n, 450)]
    assert len(rows) == chunks and (not rows or len(rows[-1].chunk) == last)


@pytest.mark.parametrize("size,overlap,says", [(50, 50, "overlap"), (0, 0, "overlap"), (-5, -10, "size")])
def test_chunk_arguments(spark, size, overlap, says):
    with pytest.raises(ValueError, match=says):
        text.chunk_documents(spark.createDataFrame([], "doc_id int, text string"), size, overlap)


def test_upload_order(spark):
    big = validate.MAX_BYTES
    rows = [
        ("Dipyrone", True, "application/pdf", 14, True, "201"), (None, True, "application/pdf", 14, True, "400 name"), (" \t", True, "application/pdf", 14, True, "400 name"),
        (None, False, None, None, None, "400 name"), ("x", False, None, None, None, "400 file"), ("x", True, "image/png", 0, False, "415 type"), ("x", True, "Application/PDF", 9, True, "415 type"),
        ("x", True, "application/pdf", 0, False, "400 empty"), ("x", True, "application/pdf", 4, False, "415 magic"), ("x", True, "application/pdf", big, True, "201"), ("x", True, "application/pdf", big + 1, False, "413"),
    ]
    frame = spark.createDataFrame(rows, "name string, file boolean, kind string, size long, magic boolean, want string")
    got = frame.select("want", validate.upload_outcome(F.col("name"), F.col("file"), F.col("kind"), F.col("size"), F.col("magic")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_uploads_of_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / "c.pdf").write_bytes(b"nope!")
    manifest = spark.createDataFrame([(f"{n}.pdf", "x", "application/pdf", True) for n in "abc"], "path string, drug_name string, content_type string, has_file boolean")
    got = {r.path: r.outcome for r in read_uploads(spark, str(tmp_path), manifest).collect()}
    assert got == {"a.pdf": "201", "b.pdf": "400 empty", "c.pdf": "415 magic"}


@pytest.mark.parametrize("x,first", [("Secret123!", None), ("Ab1!xyz", "too_short"), ("Ab1!" * 17, "too_long"), ("secret123!", "uppercase"), ("SECRET123!", "lowercase"), ("SecretABC!", "digit"), ("Secret12-", "special"), ("SecretA٣!", None)])
def test_text_rules(spark, x, first):
    got = spark.createDataFrame([(x,)], "x string").select(validate.text_violations(F.col("x")).alias("v")).first().v
    assert (got[0] if got else None) == first


def test_single_use(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(1, "a", t(1), False, t(9)), (2, "a", t(2), False, t(9)), (3, "b", t(1), False, t(1)), (4, "c", t(1), False, t(2)), (5, "c", t(3), False, t(2)), (6, "d", t(1), True, t(9)), (7, "e", t(1), None, None)]
    got = session.single_use(spark.createDataFrame(rows, "id int, token string, at timestamp, revoked boolean, until timestamp"), "token", "at", "id", "revoked", "until")
    assert {r.id for r in got.where("won").collect()} == {1, 4}


def test_access_reasons(spark):
    users = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, is_active boolean")
    tokens = spark.createDataFrame([(None,), ("abc",), ("9",), ("2",), ("3",), ("1",)], "subject string")
    got = {r.subject: r.reason for r in catalog.access_reason(tokens, users).collect()}
    assert got == {None: "missing_subject", "abc": "invalid_token", "9": "user_not_found", "2": "inactive_user", "3": "inactive_user", "1": "accepted"}


def test_rate_limit_and_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "k", t0 + dt.timedelta(seconds=i)) for i in range(6)] + [(9, "k", t0 + dt.timedelta(minutes=1)), (10, "other", t0)]
    events = spark.createDataFrame(rows, "id int, k string, at timestamp")
    assert {r.id for r in rate_limit(events, ["k"], "at", "id").where("not allowed").collect()} == {5}
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = window_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), ["k"], "at", "1 minute")
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    run.awaitTermination(120)
    got = {(r.k, r.start): r.n for r in spark.table("counts").collect()}
    assert got == {("k", t0): 6, ("k", t0 + dt.timedelta(minutes=1)): 1, ("other", t0): 1}


def test_null_flags_are_refused(spark):
    rows = [("x", None, "application/pdf", 9, True, "400 file"), ("x", True, "application/pdf", None, True, "400 empty"), ("x", True, "application/pdf", 9, None, "415 magic"), ("x", True, None, 9, True, "415 type")]
    frame = spark.createDataFrame(rows, "name string, file boolean, kind string, size long, magic boolean, want string")
    got = frame.select("want", validate.upload_outcome(F.col("name"), F.col("file"), F.col("kind"), F.col("size"), F.col("magic")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_summary_of_empty_documents(spark):
    rows = spark.createDataFrame([(1, ""), (2, None), (3, "x" * 451)], "doc_id int, text string")
    assert {tuple(r) for r in text.ingest_summary(rows).collect()} == {(1, 0, 0), (2, 0, 0), (3, 451, 2)}


def test_token_state(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    tokens = spark.createDataFrame([("a", False, t(9)), ("b", True, t(9)), ("c", False, t(2)), ("d", False, t(5))], "token string, revoked boolean, expires_at timestamp_ntz")
    attempts = spark.createDataFrame([(1, "a", t(3)), (2, "a", t(4)), (3, "b", t(1)), (4, "c", t(2)), (5, "zzz", t(1)), (6, None, t(1))], "id int, token string, at timestamp_ntz")
    after, won = session.consume(tokens, attempts, "token", "at", "id")
    assert {(r.token, r.revoked) for r in after.collect()} == {("a", True), ("b", True), ("c", False), ("d", False)}
    assert [r.id for r in won.collect()] == [1]
    rows = session.rotated(tokens, attempts, "token", "at", "id").collect()
    new = [r for r in rows if r.token not in "abcd"]
    assert len(rows) == 5 and new[0].expires_at == t(3) + dt.timedelta(days=30) and not new[0].revoked
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("no",)], "token string")
    left = session.revoke_valid(tokens, keys, "token", F.lit(t(4)).cast("timestamp_ntz"))
    assert {(r.token, r.revoked) for r in left.collect()} == {("a", True), ("b", True), ("c", False), ("d", False)}


def test_insert(spark):
    there = spark.createDataFrame([("a", 0)], "k string, n int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4), (None, 5)], "k string, n int")
    table, conflicts = mutate.insert_rows(new, there, "k", "n")
    assert {r.n for r in table.collect()} == {0, 2, 4, 5} and {r.n for r in conflicts.collect()} == {1, 3}


def test_touched_rows_and_nulls(spark):
    now = dt.datetime(2024, 2, 1)
    rows = spark.createDataFrame([(1, "x", dt.datetime(2024, 1, 1)), (2, None, dt.datetime(2024, 1, 1))], "id int not null, v string, updated_at timestamp_ntz")
    got = mutate.flag_update(rows, spark.createDataFrame([(1,), (1,)], "id int"), "id", "v", F.lit("y"), "updated_at", F.lit(now).cast("timestamp_ntz")).orderBy("id").collect()
    assert [(r.v, r.updated_at.month) for r in got] == [("y", 2), (None, 1)]
    assert [tuple(r) for r in mutate.null_counts(rows, ["id", "v"]).collect()] == [("v", 1)]
    assert mutate.null_counts(mutate.backfill(rows, "v", F.lit("z")), ["id", "v"]).count() == 0
    assert not rows.schema["id"].nullable and mutate.relaxed(rows, "id").schema["id"].nullable


def test_report(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"totals": {"percent_covered": 79.96, "num_statements": 10},\n "files": {"b.py": {"summary": {"percent_covered": 50.0, "num_statements": 4, "missing_lines": 2}}, "c.py": {}, "a.py": {"summary": {"percent_covered": 50.0, "num_statements": 2}}}}')
    told = sources.read_report(spark, f"{tmp_path}/r.json")
    lines = report.report_lines(report.report_totals(told), report.report_items(told))
    want = ["| `TOTAL` | 80.0% | 10 | 0 |", "| `c.py` | 0.0% | 0 | 0 |", "| `a.py` | 50.0% | 2 | 0 |", "| `b.py` | 50.0% | 4 | 2 |"]
    assert [r.line for r in lines.collect()] == want
    sources.write_lines(lines.select("line").coalesce(1), f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == want


@pytest.mark.parametrize("x,two,share", [(2.675, 2.67, "2.7%"), (87.425, 87.42, "87.4%"), (0.125, 0.12, "0.1%"), (0.25, 0.25, "0.2%"), (-1.005, -1.0, "-1.0%")])
def test_rounding(spark, x, two, share):
    got = spark.range(1).select(functions.rounded(F.lit(x)).alias("r"), functions.percent(F.lit(x)).alias("p")).first()
    assert (got.r, got.p) == (two, share) == (round(x, 2), f"{x:.1f}%")


@pytest.mark.parametrize("x,weak", [(None, True), ("", True), ("x" * 31, True), ("x" * 32, False), ("CHANGE-ME" + "-" * 30, True)])
def test_weak_secret(spark, x, weak):
    frame = spark.createDataFrame([(x,)], "x string")
    assert frame.select(validate.weak_secret(F.col("x"), ["change-me" + "-" * 30]).alias("w")).first().w is weak


@pytest.mark.parametrize("x,ok", [("a.b+c@x.org", True), ("a@b", False), ("a b@x.org", False), ("@x.org", False)])
def test_email_like(spark, x, ok):
    assert spark.range(1).select(functions.email_like(F.lit(x)).alias("o")).first().o is ok


def test_magic(spark):
    rows = spark.createDataFrame([(b"%PDF-",), (b"%PDF",), (b"",), (None,)], "b binary")
    assert [r.m for r in rows.select(functions.has_magic(F.col("b"), b"%PDF-").alias("m")).collect()] == [True, False, False, None]


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([('{"event": "login", "correlation_id": "", "status_code": 200}',), ('{"event": "out", "correlation_id": "c-1"}',)], "value string")
    parsed = parse_logs(rows, "1.2", "test")
    sources.write_logs(parsed, f"{tmp_path}/logs")
    got = {r.event: r for r in sources.read_logs(spark, f"{tmp_path}/logs").collect()}
    assert got["out"].correlation_id == "c-1" and len(got["login"].correlation_id) == 36 and got["login"].status_code == 200 and got["out"].app_version == "1.2"


def test_sinks_and_payloads(spark, tmp_path):
    rows = spark.createDataFrame([(1, b"%PDF-1", "Dip", "201"), (2, b"no", "x", "415 magic")], "id long, data binary, drug_name string, outcome string")
    objects, catalog_rows, refused = plans.ingest_uploads(rows, F.col("data"), F.lit("2024"))
    for _ in range(2):
        sources.append_table(objects, f"{tmp_path}/objects")
    kept = spark.read.parquet(f"{tmp_path}/objects")
    assert kept.count() == 2 and kept.select("sha256_checksum").distinct().count() == 1
    assert [r.status for r in catalog_rows.collect()] == ["pending"] and [r.id for r in refused.collect()] == [2]
    keys = spark.createDataFrame([(1,), (9,), (9,)], "id long")
    found, missing = catalog.payloads(keys, rows, "id", "data")
    assert [(r.id, bytes(r.data)) for r in found.collect()] == [(1, b"%PDF-1")] and [r.id for r in missing.collect()] == [9]


def test_responses(spark):
    rows = spark.createDataFrame([(1, None, b"blob")], "id int, manufacturer string, data binary")
    assert catalog.responses(rows, ["id", "manufacturer"]).first().response == '{"id":1,"manufacturer":null}'


def test_sizes_are_pushed_to_the_file_reader(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    manifest = spark.createDataFrame([("a.pdf", "x", "application/pdf", True)], "path string, drug_name string, content_type string, has_file boolean")
    plan = read_uploads(spark, str(tmp_path), manifest)._jdf.queryExecution().toString()
    assert f"LessThanOrEqual(length,{validate.MAX_BYTES})" in plan


def test_upload_stream(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    (files / "a.pdf").write_bytes(b"%PDF-1.4")
    (files / "c.pdf").write_bytes(b"nope!")
    manifest = spark.createDataFrame([(f"{n}.pdf", "x", "application/pdf", True) for n in "abc"], "path string, drug_name string, content_type string, has_file boolean")
    for new in ("a", "b"):
        if new == "b":
            (files / "b.pdf").write_bytes(b"%PDF-2")
        sources.append_stream(sources.stream_uploads(spark, str(files), manifest), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = {(r.path, r.outcome, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a.pdf", "201", "pending"), ("b.pdf", "201", "pending"), ("c.pdf", "415 magic", None)}


def ran(stream, tmp_path, name):
    sources.append_stream(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-cp").awaitTermination(120)
    return stream.sparkSession.read.parquet(f"{tmp_path}/{name}")


def test_single_use_streams(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    shape = "id int, token string, at timestamp, revoked boolean, until timestamp"
    batches = [[(1, "a", t(1), True, t(9)), (2, "a", t(2), False, t(9)), (3, "b", t(3), False, t(3))], [(4, "a", t(4), False, t(9)), (5, "b", t(2), False, t(3)), (6, "c", t(4), None, None)]]
    read = lambda: spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
    won = set()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = ran(single_use_stream(read(), "token", "at", "id", "revoked", "until"), tmp_path, "all")
        won = {r.id for r in got.where("won").collect()}
        assert won == [{2}, {2, 5}][i]
    assert got.count() == 6
    first = ran(first_use(read(), "token", "at", revoked="revoked", expires_at="until"), tmp_path, "first")
    assert {r.id for r in first.collect()} == {2, 5} or {r.id for r in first.collect()} == {4, 5}


def test_late_rows_of_a_window_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    shape = "id int, k string, at timestamp"
    for rows in ([(1, "k", t0), (2, "k", t0 + dt.timedelta(minutes=30))], [(3, "k", t0), (4, "k", t0 + dt.timedelta(minutes=60))], [(5, "k", t0 + dt.timedelta(minutes=90))]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = ran(window_counts(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), ["k"], "at", "1 minute"), tmp_path, "counts")
    # the late row isn't counted, and windows come out once the watermark has passed them
    assert {(r.start, r.n) for r in got.collect()} >= {(t0, 1), (t0 + dt.timedelta(minutes=30), 1)}


def test_dense_topk(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.dense_topk(vectors, queries, 5).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 20):
        assert [got[q, k] for k in range(1, 6)] == np.argsort(-(unit @ unit[q]))[:5].tolist()


@pytest.mark.parametrize("depth", [3, 200])
def test_hybrid_is_that_of_whole_rankings(spark, depth):
    rng = np.random.default_rng(2)
    ranks = [{q: (rng.permutation(60)[:n] + (0 if q else 0)).tolist() for q in range(3)} for n in (60, 40)]
    frames = [spark.createDataFrame([(q, int(d), k) for q, ds in one.items() for k, d in enumerate(ds, 1)], "q long, d long, rank int").cache() for one in ranks]
    lists = [lambda n, f=f: f.where(F.col("rank") <= n) for f in frames]
    got = {(r.q, r["rank"]): r.d for r in retrieval.hybrid_topk(*lists, "q", "d", 5, depth).collect()}
    for q in range(3):
        score = {}
        for one in ranks:
            for k, d in enumerate(one[q], 1):
                score[d] = score.get(d, 0) + 1 / (60 + k)
        want = sorted(score, key=lambda d: (-round(score[d], 6), d))[:5]
        assert [got[q, k] for k in range(1, 6)] == want

import datetime as dt
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from docspark import sources
from docspark.operators.validate import MAX_BYTES
from docspark.streaming import uploads

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
MANIFEST = "path string, drug_name string, content_type string, has_file boolean, sent_at timestamp"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A state store for each partition is opened in each run; two show as much as more."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")



def put(folder, name, data, minute):
    (folder / name).write_bytes(data)
    os.utime(folder / name, (T0.timestamp() + 60 * minute,) * 2)


def row(name, minute, drug="x", kind="application/pdf", there=True):
    return (name, drug, kind, there, T0 + dt.timedelta(minutes=minute))


@pytest.fixture
def arrivals(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()

    def arrive(new, rows):
        for name, data, minute in new:
            put(files, name, data, minute)
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/manifest")
        manifest = spark.readStream.schema(MANIFEST).parquet(f"{tmp_path}/manifest")
        return uploads.judge_uploads(uploads.stream_files(spark, str(files)), manifest)

    return arrive


FIRST = ([("a.pdf", b"%PDF-1", 0), ("b.pdf", b"", 0), ("stray.pdf", b"%PDF-2", 1), ("c.pdf", b"nope!", 1)], [row("a.pdf", 0), row("b.pdf", 0), row("c.pdf", 1), row("none.pdf", 1, there=False)])
SECOND = ([("early.pdf", b"%PDF-3", 3), ("big.pdf", b"%PDF-" + b"x" * MAX_BYTES, 2)], [row("big.pdf", 2), row("late.pdf", 2)])
THIRD = ([("late.pdf", b"%PDF-4", 9)], [row("early.pdf", 5), row("early.pdf", 6, drug=" ")])
#: Far later, so that the watermarks pass all that was before.
LAST = ([("z.pdf", b"%PDF-9", 600)], [row("z.pdf", 600)])


def test_every_file_and_row_is_judged(spark, tmp_path, arrivals):
    for new, rows in (FIRST, SECOND, THIRD, LAST, ([], [row("y.pdf", 601, there=False)])):
        sources.append_stream(arrivals(new, rows), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(180)
    got = sorted((r.path, r.outcome) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [
        ("a.pdf", "201"), ("b.pdf", "400 empty"), ("big.pdf", "413"), ("c.pdf", "415 magic"), ("early.pdf", "201"), ("early.pdf", "400 name"), ("late.pdf", "201"),
        ("none.pdf", "400 file"), ("stray.pdf", "404 unlisted"), ("z.pdf", "201"),
    ]


def store(spark, judged, folder):
    return uploads.store_uploads(judged, f"{folder}/objects", f"{folder}/catalog", f"{folder}/refused", f"{folder}/cp", F.col("checksum"), F.lit("2024"))


def tables(spark, folder):
    return spark.read.parquet(f"{folder}/objects"), spark.read.parquet(f"{folder}/catalog")


def test_two_tables_as_one(spark, tmp_path, arrivals, monkeypatch):
    store(spark, arrivals(*FIRST), tmp_path).awaitTermination(180)
    whole = uploads.compensated

    def ends_between(first, then, undo):  # as when the process ends between the two writes: nothing is undone
        first()
        raise RuntimeError("gone")

    monkeypatch.setattr(uploads, "compensated", ends_between)
    with pytest.raises(StreamingQueryException, match="gone"):
        store(spark, arrivals(*SECOND), tmp_path).awaitTermination(180)
    monkeypatch.setattr(uploads, "compensated", whole)
    for new, rows in (THIRD, LAST):
        store(spark, arrivals(new, rows), tmp_path).awaitTermination(180)
    objects, catalog = tables(spark, tmp_path)
    assert objects.count() == catalog.count() == objects.select("object_address").distinct().count() == 4
    assert uploads.reconcile(spark, f"{tmp_path}/objects", f"{tmp_path}/catalog").count() == 0


def test_orphans_are_removed_from_their_partitions_only(spark, tmp_path):
    for batch, addresses, named in ((0, "ab", "ab"), (1, "cd", "c"), (2, "e", None)):
        spark.createDataFrame([(x, 1) for x in addresses], "object_address string, content_size_bytes int").write.parquet(f"{tmp_path}/objects/batch={batch}")
        if named:
            spark.createDataFrame([(x,) for x in named], "file_address string").write.parquet(f"{tmp_path}/catalog/batch={batch}")
    before = sorted(f for f in os.listdir(tmp_path / "objects/batch=0") if f.startswith("part"))
    assert [r.object_address for r in uploads.reconcile(spark, f"{tmp_path}/objects", f"{tmp_path}/catalog").collect()] == ["d"]
    assert uploads.remove_orphans(spark, f"{tmp_path}/objects", f"{tmp_path}/catalog", f"{tmp_path}/scratch") == 1
    assert {r.object_address for r in spark.read.parquet(f"{tmp_path}/objects").collect()} == set("abce")  # batch 2 isn't over
    assert sorted(f for f in os.listdir(tmp_path / "objects/batch=0") if f.startswith("part")) == before


def test_the_first_error_is_kept():
    done = []

    def fails(what):
        raise ValueError(what)

    with pytest.raises(ValueError, match="catalog"):
        uploads.compensated(lambda: done.append("objects"), lambda: fails("catalog"), lambda: fails("undo"))
    with pytest.raises(ValueError, match="objects"):
        uploads.compensated(lambda: fails("objects"), lambda: done.append("never"), lambda: done.append("never"))
    uploads.compensated(lambda: done.append("one"), lambda: done.append("two"), lambda: done.append("never"))
    assert done == ["objects", "one", "two"]


def test_large_files_are_not_opened(spark, tmp_path):
    plan = uploads.stream_files(spark, str(tmp_path))
    assert plan.isStreaming and plan.columns == ["path", "found_at", "size", "magic", "checksum"]

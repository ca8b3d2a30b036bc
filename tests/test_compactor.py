import os

from siltstone.session import published
from siltstone.streaming.compactor import Compactor, remap_index

SCHEMA = "store_id int, run_id long, key string, value string, file_id long, offset long"


def write(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def compactor(spark, tmp_path, **kw):
    schema = spark.createDataFrame([], SCHEMA).schema
    return Compactor(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", schema, **kw)


def test_each_record_once_over_late_files(spark, tmp_path, collected):
    src = f"file://{tmp_path}/in"
    write(spark, [(1, 1, "a", "v", 10, 0), (1, 1, "a", "v", 9, 0), (1, 1, "b", "v", 10, 5), (None, 1, "x", "v", 1, 1), (1, 1, None, "v", 1, 1)], src)
    c = compactor(spark, tmp_path, files_per_batch=1)
    c.run()
    write(spark, [(1, 1, "a", "v", 30, 7), (1, 2, "a", "v", 30, 9), (1, 2, "", None, 30, 11)], src)
    c.run()
    c.run()
    assert collected(c.records().select("store_id", "run_id", "key")) == [(1, 1, "a"), (1, 1, "b"), (1, 2, ""), (1, 2, "a")]
    # of copies in one batch the least file counts
    assert c.records().where("run_id = 1 and key = 'a'").first().file_id == 9
    index = spark.createDataFrame([(1, 1, 10, "a", None), (1, 1, 10, "a", 99), (1, 1, 10, None, 4), (1, 9, 10, "gone", 4), (1, 2, 30, "a", 9)], "store_id int, run_id long, file_id long, key string, offset long")
    got = remap_index(index, c.locations()).collect()
    assert sorted((r.run_id, r.key) for r in got) == [(1, "a"), (2, "a")]
    for r in got:
        path = f"{tmp_path}/out/data/{r.data_file}"
        assert spark.read.parquet(path).select("key", "run_id", "_metadata.row_index").where(f"row_index = {r.row_in_file}").first()[:2] == (r.key, r.run_id)


def test_retry_replaces_a_batch(spark, tmp_path, collected):
    write(spark, [(1, 1, "a", "v", 1, 0)], f"file://{tmp_path}/in")
    c = compactor(spark, tmp_path)
    df = spark.read.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
    c._write(df, 0)
    c._write(df, 0)
    assert c.records().count() == 1
    assert list(published(spark, c.target)["parts"]) == ["0"]


def test_small_batches_settle_into_one(spark, tmp_path, collected):
    c = compactor(spark, tmp_path, files_per_batch=1)
    for i in range(4):
        write(spark, [(1, i, f"k{j}", "v", i, j) for j in range(5)] + [(1, 0, "k0", "v", i + 50, 0)], f"file://{tmp_path}/in")
    c.run(settle=False)
    before = collected(c.records())
    assert len(before) == 20 and len({p["folder"] for p in c._parts().values()}) == 4
    c.settle()
    c.vacuum()
    assert collected(c.records()) == before and len(os.listdir(tmp_path / "out" / "data")) == 1
    c._write(spark.createDataFrame([(1, 0, "k0", "v", 50, 0)], SCHEMA), 0)  # repeated after it was settled
    assert collected(c.records()) == before
    write(spark, [(1, 0, "k0", "v", 90, 0), (1, 9, "new", "v", 90, 1)], f"file://{tmp_path}/in")
    c.run()
    assert c.records().count() == 21


def test_empty_source_and_few_files(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    c = compactor(spark, tmp_path)
    c.run()
    assert c.records().count() == 0 and c.locations().count() == 0
    for i in range(12):
        write(spark, [(1, i, f"k{j}", "v", i, j) for j in range(10)], f"file://{tmp_path}/in")
    c.run()
    made = [f for _, _, fs in os.walk(tmp_path / "out" / "data") for f in fs if f.endswith(".parquet")]
    assert c.records().count() == 120 and len(made) == 1


def test_rows_are_counted_as_written(spark, tmp_path):
    """A batch of copies leaves no folder; one with one new record counts one, and small folders settle."""
    c = compactor(spark, tmp_path, files_per_batch=1, file_rows=10)
    src = f"file://{tmp_path}/in"
    first = [(1, 1, f"k{j}", "v", 1, j) for j in range(4)]
    write(spark, first, src)
    c.run(settle=False)
    write(spark, first * 3, src)
    c.run(settle=False)
    write(spark, first * 3 + [(1, 2, "new", "v", 3, 0)], src)
    c.run(settle=False)
    assert [p["rows"] for p in c._parts().values()] == [4, 1]
    c.run()
    assert {p["rows"] for p in c._parts().values()} == {5} and len({p["folder"] for p in c._parts().values()}) == 1
    assert c.records().count() == 5


def test_a_retry_shows_the_former_attempt_until_it_is_whole(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    c = compactor(spark, tmp_path)
    df = spark.createDataFrame([(1, 1, "a", "v", 1, 0), (1, 1, "b", "v", 1, 0)], SCHEMA)
    c._write(df, 0)
    with pytest.raises(Exception):
        c._write(df.withColumn("value", F.raise_error(F.lit("lost")).cast("string")), 0)
    assert c.records().count() == 2
    before = c.records()
    c._write(df, 0)
    assert before.count() == 2 and c.records().count() == 2
    c.vacuum()
    assert c.records().count() == 2 and len(os.listdir(tmp_path / "out" / "data" / "batch=0000000000")) == 1


def test_a_batch_is_compared_with_overlapping_files_only(spark, tmp_path, monkeypatch):
    from siltstone.streaming import compactor as module

    monkeypatch.setattr(module, "BLOCK_RUNS", 10)
    c = compactor(spark, tmp_path, file_rows=50)
    c._write(spark.createDataFrame([(s, r, f"k{j}", "v", r, j) for s in (1, 2) for r in range(40) for j in range(5)], SCHEMA), 0)
    files = {f for _, _, fs in os.walk(tmp_path / "out" / "data") for f in fs if f.endswith(".parquet")}
    late = spark.createDataFrame([(2, 37, "k1", "v", 99, 0), (2, 38, "new", "v", 99, 0)], SCHEMA)
    asked = c.overlapping(late, c._parts())
    assert len(files) >= 8 and 0 < len(asked) <= 3
    c._write(late, 1)
    assert c.records().count() == 401 and c.overlapping(spark.createDataFrame([(3, 1, "a", "v", 1, 1), (None, 1, "a", "v", 1, 1)], SCHEMA), c._parts()) == []


def test_files_are_sized_by_bytes(spark, tmp_path):
    import random

    r = random.Random(1)
    rows = [(1, i % 7, f"{r.random()}", "".join(chr(r.randint(97, 122)) for _ in range(400)), i, 0) for i in range(2000)]
    write(spark, rows, f"file://{tmp_path}/in")
    c = compactor(spark, tmp_path, file_bytes=200_000)
    c.run()
    made = [os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "out" / "data") for f in fs if f.endswith(".parquet")]
    assert 3 <= len(made) <= 6 and c.records().count() == 2000

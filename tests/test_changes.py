import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import changes
from siltstone.session import published

SCHEMA = "store_id int, key string, wal_gen int, seq long, is_put boolean"


def brute(rows):
    best = {}
    for s, k, g, q, p in rows:
        if None in (s, k, g, q, p):
            continue
        new = (g, q, not p)
        if (s, k) not in best or new > best[s, k]:
            best[s, k] = new
    return sorted((s, k, g, q) for (s, k), (g, q, d) in best.items() if not d)


@pytest.mark.parametrize("split", [None, 50])
def test_against_brute_force(spark, tmp_path, collected, monkeypatch, split):
    if split:
        monkeypatch.setattr(changes, "SPLIT_ROWS", split)
        monkeypatch.setattr(changes, "STEP_ROWS", 40)
    r = random.Random(3)
    rows = []
    for _ in range(3000):
        key = "hot" if r.random() < 0.4 else r.choice(["", "x" * 5000, None, *map(str, range(300))])
        rows.append((r.choice([1, 2, None]), key, r.randint(1, 3), r.randint(1, 200), r.choice([True, False, None])))
    rows += rows[:500]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("value", F.lit(1)).withColumn("bucket", F.lit("clash"))
    t = changes.ChangeTable(spark, f"file://{tmp_path}/t")
    assert t.state().count() == 0
    t.apply(df)
    # pairs that claim both a put and a delete are decided by the delete, in any order of arrival
    assert collected(t.live()) == brute(rows)


def test_batches_in_any_order_and_twice(spark, tmp_path, collected):
    rows = [(1, "a", 1, 1, True), (1, "a", 1, 5, False), (1, "a", 1, 3, True), (1, "b", 2, 1, True), (1, "b", 1, 9, False)]
    whole = brute(rows)
    t = changes.ChangeTable(spark, f"file://{tmp_path}/t")
    for part in ([rows[1], rows[3]], [rows[0], rows[4]], [rows[2]], [rows[2]]):
        t.apply(spark.createDataFrame(part, SCHEMA), groups=3)
    assert collected(t.live()) == whole == [(1, "b", 2, 1)]
    assert t.state().where("not is_put").count() == 1


def test_failed_apply_leaves_the_published_version(spark, tmp_path, collected):
    t = changes.ChangeTable(spark, f"file://{tmp_path}/t")
    t.apply(spark.createDataFrame([(1, "a", 1, 1, True)], SCHEMA))
    before = published(spark, t.path)
    bad = spark.createDataFrame([(1, "z", 1, 1, True)], SCHEMA).withColumn("seq", F.raise_error(F.lit("x")).cast("long"))
    with pytest.raises(Exception):
        t.apply(bad, groups=2)
    assert published(spark, t.path) == before
    assert collected(t.live()) == [(1, "a", 1, 1)]
    t.apply(spark.createDataFrame([], SCHEMA))
    t.vacuum()
    assert collected(t.live()) == [(1, "a", 1, 1)]


def test_values_follow_their_change(spark, tmp_path, collected):
    schema = SCHEMA + ", value string"
    rows = [(1, "a", 1, 1, True, "old"), (1, "a", 1, 2, True, None), (1, "a", 1, 2, True, ""), (1, "b", 1, 3, False, "x"), (1, "b", 1, 2, True, "y"), (1, "c", 1, 1, True, None)]
    t = changes.ChangeTable(spark, f"file://{tmp_path}/t", values=True)
    for r in (rows[3:], rows[:3], rows):
        t.apply(spark.createDataFrame(r, schema), groups=2)
    assert collected(t.live()) == [(1, "a", 1, 2, ""), (1, "c", 1, 1, None)]


def test_follow_a_stream(spark, tmp_path, collected):
    path, t = f"file://{tmp_path}/feed", changes.ChangeTable(spark, f"file://{tmp_path}/t")
    for part in ([(1, "a", 1, 2, False)], [(1, "a", 1, 1, True), (1, "b", 1, 3, True)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        t.follow(spark.readStream.schema(SCHEMA).parquet(path), f"file://{tmp_path}/cp")
    assert collected(t.live()) == [(1, "b", 1, 3)]


def test_large_values_are_passed_on_early(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "STEP_BYTES", 1 << 16)
    monkeypatch.setattr(changes, "SPLIT_BYTES", 1 << 18)
    df = spark.range(600).select(F.lit(1).alias("store_id"), (F.col("id") % 200).cast("string").alias("key"), F.lit(1).alias("wal_gen"), F.col("id").alias("seq"), F.lit(True).alias("is_put"), F.repeat(F.lit("v"), 20_000).alias("value"))
    t = changes.ChangeTable(spark, f"file://{tmp_path}/t", values=True)
    t.apply(df)
    assert t.live().where("seq >= 400 and length(value) = 20000").count() == 200


def test_op_words(spark):
    df = spark.createDataFrame([(w,) for w in ["PUT", " put ", "Put", "0", "DELETE", "del", "1", "", None, "PUT?", "NOOP"]], "op string")
    assert [r[0] for r in df.select(changes.is_put(F.col("op"))).collect()] == [True] * 4 + [False] * 3 + [None] * 4


def test_untouched_groups_stay(spark, tmp_path, collected):
    t = changes.ChangeTable(spark, f"file://{tmp_path}/t")
    first = t.apply(spark.createDataFrame([(1, str(k), 1, 1, True) for k in range(50)], SCHEMA), groups=8)
    second = t.apply(spark.createDataFrame([(1, "7", 1, 2, False)], SCHEMA), groups=3)
    at = published(spark, t.path)["at"]
    versions = [held["version"] for held in at.values()]
    assert sorted(set(versions)) == sorted({first, second}) and versions.count(second) == 1 and sum(held["rows"] for held in at.values()) == 50
    assert collected(t.live().select("key")) == sorted(((str(k),) for k in range(50) if k != 7), key=repr)
    t.vacuum()
    assert t.live().count() == 49


def test_a_table_grows_far_beyond_its_first_call(spark, tmp_path, monkeypatch):
    """Twenty times the first call, with values of several times the memory that one bucket has."""
    monkeypatch.setattr(changes, "BUCKET_ROWS", 1500)
    monkeypatch.setattr(changes, "BUCKET_BYTES", 8 << 20)
    monkeypatch.setattr(changes, "MEMORY", "64MB")
    monkeypatch.setattr(changes, "STEP_BYTES", 2 << 20)
    monkeypatch.setattr(changes, "SPLIT_BYTES", 8 << 20)
    t = changes.ChangeTable(spark, f"file://{tmp_path}/t", values=True)

    def feed(low, high):
        random_text = F.concat(*(F.sha2(F.concat("id", F.lit(f"-{k}")), 512) for k in range(24)))
        return spark.range(low, high).select(F.lit(1).alias("store_id"), F.col("id").cast("string").alias("key"), F.lit(1).alias("wal_gen"), F.col("id").alias("seq"), F.lit(True).alias("is_put"), random_text.alias("value"))

    t.apply(feed(0, 2000), groups=2)
    for k in range(1, 20, 5):
        t.apply(feed(2000 * k, 2000 * (k + 5)))
    now = published(spark, t.path)
    assert now["groups"] == 2 and sum(held["rows"] for held in now["at"].values()) == 42_000
    assert t.live().where("length(value) = 3072").agg(F.count_distinct("key")).first()[0] == 42_000
    t.vacuum()
    assert t.live().count() == 42_000


def test_of_two_writers_one_fails(spark, tmp_path):
    from siltstone import session

    base = f"file://{tmp_path}/t"
    session.publish(spark, base, "a")
    with pytest.raises(Exception):
        fs, claim = session.hadoop_path(spark, f"{base}/_manifests/claim-{0:010d}")
        fs.create(claim, False)
    fs, claim = session.hadoop_path(spark, f"{base}/_manifests/claim-{1:010d}")
    fs.create(claim, False).close()  # claimed and never published
    assert published(spark, base)["version"] == "a"
    session.publish(spark, base, "b")
    assert published(spark, base)["version"] == "b"
    session.vacuum_manifests(spark, base)
    assert published(spark, base)["version"] == "b"


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from siltstone import session

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x:7077", getConf=lambda: {}))
    with pytest.raises(ValueError):
        session.shared_root(away)

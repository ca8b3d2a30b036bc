"""Hand-made cases of the store's semantics."""

import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.functions.hashing import bit_position, fnv_hash, mix_hash, sha_hash
from siltstone.functions.ordinal import with_ordinal, with_previous
from siltstone.functions.units import to_millis
from siltstone.operators import cache, probe, runs, state, ttl, wal
from siltstone.sources import files

LOG = "seq long, op string, key string, value string"


def log(spark, *entries):
    return spark.createDataFrame([(i, *e) for i, e in enumerate(entries, 1)], LOG)


@pytest.mark.parametrize(
    "entries, want",
    [
        ([("PUT", "a", "1"), ("PUT", "a", "2")], [("a", "2")]),
        ([("PUT", "a", "1"), ("DELETE", "a", ""), ("PUT", "a", "3")], [("a", "3")]),
        ([("PUT", "a", "1"), ("DELETE", "a", "")], []),
        ([("PUT", "a", "__<deleted>__")], [("a", "__<deleted>__")]),
        ([("PUT", "a", "1"), ("PUT_TTL", "a", "2")], [("a", "1")]),
        ([("PUT", "a", "")], [("a", "")]),
        ([("PUT", "a", None)], [("a", None)]),
        ([("PUT", "x::||::y", "1")], [("x::||::y", "1")]),
        ([("PUT", None, "1")], []),
        ([], []),
    ],
)
def test_live(spark, collected, entries, want):
    assert collected(state.live(log(spark, *entries))) == want


def test_repeated_and_clashing(spark, collected):
    df = log(spark, ("PUT", "a", "1"), ("PUT", "b", "2"))
    df = df.union(df).withColumn("last", F.lit(9)).withColumn("ordinal", F.lit(8))
    assert collected(state.live(df)) == [("a", "1"), ("b", "2")]
    assert [r.ordinal for r in with_ordinal(df.distinct(), "seq").orderBy("seq").collect()] == [0, 1]


def test_delete_of_flushed_key(spark, collected):
    df = log(spark, ("PUT", "a", "1"), ("PUT", "b", "1"), ("DELETE", "a", ""), ("PUT", "c", "1"))
    assert collected(state.live(df)) == [("b", "1"), ("c", "1")]
    assert collected(runs.as_coded_deletes(df, 2)) == [("a", "1"), ("b", "1"), ("c", "1")]


def test_merge_and_tiers(spark, collected):
    df = spark.createDataFrame([(r, "a", r, str(r)) for r in range(1, 5)], "run_id long, key string, seq long, value string")
    assert [r.value for r in runs.merge(df).collect()] == ["4"]
    assert [r.value for r in runs.merge(df, newest=False).collect()] == ["1"]
    two = df.withColumn("level", F.lit(0))
    assert [r.value for r in runs.tiered_get(two).collect()] == ["4"]
    assert [r.value for r in runs.tiered_get(two, newest=False).collect()] == ["1"]


@pytest.mark.parametrize("n", [1, 4, 5, 15, 16, 63, 70])
def test_tier_levels_follow_a_simulation(spark, n):
    levels = {}
    for r in range(n):
        level, block = 0, [r]
        levels.setdefault(0, []).append(block)
        while len(levels[level]) == 4:
            block = [x for b in levels[level] for x in b]
            levels[level], level = [], level + 1
            levels.setdefault(level, []).append(block)
    want = {r: lvl for lvl, blocks in levels.items() for b in blocks for r in b}
    ids = spark.range(n).withColumnRenamed("id", "run_id")
    got = runs.tiers(ids, n)
    assert {r.run_id: r.level for r in got.collect()} == want


def test_purge_keeps_needed_tombstones(spark, collected):
    schema = "run_id long, key string, seq long, op string, value string"
    df = spark.createDataFrame([(0, "a", 1, "PUT", "1"), (4, "a", 9, "DELETE", ""), (5, "b", 10, "DELETE", "")], schema)
    got = runs.merge_tiers(df).select("grp", "key", "op")
    assert collected(got) == [(0, "a", "PUT"), (1, "a", "DELETE")]


def test_ttl_boundary_and_trigger(spark):
    df = spark.createDataFrame([("a", "v", 100), ("b", "v", 99), ("c", "v", None)], "key string, value string, expiry_ms long")
    assert {r.key for r in ttl.live_at(df, 100).collect()} == {"a", "c"}
    assert {r.expired: r.n for r in ttl.sweep_counts(df, 100).collect()} == {True: 2, False: 1}
    four = spark.createDataFrame([(str(i), "v", 1) for i in range(4)], df.schema)
    assert ttl.triggers(ttl.sample(four), 100).first().sweep is False
    assert ttl.triggers(ttl.sample(four.limit(0)), 100).first().sampled == 0


def test_stored_entries(spark, collected):
    rows = [(1, "a", "x", True, 10), (1, "a", "y", True, 30), (1, "a", "y", True, 30), (1, "b", "z", None, 5), (1, "b", "w", True, 9), (2, "a", None, True, 0), (2, "c", None, True, 7), (2, "c", "", True, 7), (None, "a", "v", True, 1), (1, None, "v", True, 1)]
    df = spark.createDataFrame(rows, "store_id int, key string, value string, TTL boolean, expiryTime long")
    got = ttl.from_store(df)
    assert collected(got) == [(1, "a", "y", 30), (1, "b", "z", None), (2, "a", None, None), (2, "c", "", 7)]
    assert collected(ttl.live_at(got, 20).select("store_id", "key")) == [(1, "a"), (1, "b"), (2, "a")]
    assert ttl.from_store(df.limit(0)).count() == 0


def test_units(spark):
    df = spark.createDataFrame([(2, "HOURS"), (1, "DAYS"), (1, "X"), (None, "DAYS")], "n long, u string")
    assert [r[0] for r in df.select(to_millis(F.col("n"), F.col("u"))).collect()] == [7200000, 86400000, None, None]


def emulated(key, kind):
    h = {"fnv": 0x811C9DC5, "mix": 0x9747B28C}[kind]
    for b in key.encode():
        h ^= (b - 256 if b >= 128 else b) & 0xFFFFFFFF
        if kind == "fnv":
            h = h * 0x01000193 & 0xFFFFFFFF
        else:
            h = h * 0x5BD1E995 & 0xFFFFFFFF
            h ^= h >> 15
    return h - 2**32 if h >= 2**31 else h


def test_hashes_follow_signed_bytes(spark):
    keys = ["", "a", "cust:1", "größe", "漢字", "x" * 300]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = df.select("k", fnv_hash(F.col("k")).alias("f"), mix_hash(F.col("k")).alias("m"), bit_position(sha_hash(F.col("k"))).alias("s")).collect()
    for r in got:
        assert (r.f, r.m) == (emulated(r.k, "fnv"), emulated(r.k, "mix"))
        assert 0 <= r.s < 10_000
    assert spark.createDataFrame([(None,)], "k string").select(fnv_hash(F.col("k"))).first()[0] is None


def test_filters_have_no_false_negatives(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("run_id"), F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("seq"), F.lit("v").alias("value"))
    assert probe.probe_filters(df.select("run_id", "key"), probe.filters(df)).where("not may_contain").count() == 0


def test_vectorised_hashes_are_the_expressions(spark):
    import random

    from siltstone.functions.hashing import bit_positions, with_bits

    r = random.Random(2)
    keys = ["", None, "a", "größe", "漢字", "x" * 511, "y" * 512, "z" * 5000, *("".join(chr(r.choice([65, 233, 0x3042, 0x1F600])) for _ in range(r.randint(0, 40))) for _ in range(50))]
    df = spark.createDataFrame([(i, k, 7) for i, k in enumerate(keys)], "run_id long, key string, bits int")
    for n in (10_000, 64):
        got = {x.run_id: x.bits for x in with_bits(df, n).collect()}
        want = {x.run_id: x.p for x in df.select("run_id", bit_positions(F.col("key"), n).alias("p")).collect()}
        assert got == want
    assert with_bits(df.limit(0)).count() == 0


def test_probing_nulls_repeats_and_missing_runs(spark, collected):
    runs_ = spark.createDataFrame([(1, "a", "v"), (1, None, "v"), (2, "", None)], "run_id long, key string, value string")
    asked = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, ""), (9, "a")], "run_id long, key string")
    assert collected(probe.probe_filters(asked, probe.filters(runs_))) == sorted([(1, "a", True), (1, None, False), (2, "", True), (9, "a", False)], key=repr)
    got = collected(probe.point_reads(asked, runs_, probe.filters(runs_), probe.sparse_index(runs_)))
    assert got == sorted([(1, "a", True, 0, "v"), (1, None, False, None, None), (2, "", True, 0, None), (9, "a", False, None, None)], key=repr)
    assert probe.filters(runs_.limit(0)).count() == 0 and probe.sparse_index(runs_.limit(0)).count() == 0


def test_record_lengths_and_index_over_batches(spark):
    rows = [("k", "v"), ("k" * 127, "v" * 128), ("k" * 128, None), ("", ""), ("k", "v" * 20_000)]
    df = spark.createDataFrame(rows, "key string, value string").select(probe.record_bytes().alias("n"))
    assert [r.n for r in df.collect()] == [11 + 3 + 3, 11 + 2 + 127 + 3 + 128, 11 + 3 + 128, 11, 11 + 3 + 4 + 20_000]
    long = spark.range(9000).selectExpr("id div 5000 as run_id", "lpad(cast(id as string), 6, '0') as key", "repeat('v', cast(id % 50 as int)) as value")
    want, at, since, run = [], 0, 0, None
    for r in long.orderBy("run_id", "key").collect():
        if r.run_id != run:
            run, at, since = r.run_id, 0, 0
        if at - since > 4096:
            want.append((r.run_id, r.key, at))
            since = at
        at += 11 + 8 + (2 + len(r.value) if r.value else 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        assert sorted(map(tuple, probe.sparse_index(long).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_index_floor(spark, collected):
    index = spark.createDataFrame([(0, "b", 10), (0, "d", 20)], "run_id long, key string, offset long")
    asked = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (0, "z"), (1, "z")], "run_id long, key string")
    assert collected(probe.index_floor(asked, index)) == [(0, "a", 0), (0, "b", 10), (0, "c", 10), (0, "z", 20), (1, "z", 0)]


def test_ordinal_and_previous_across_blocks(spark):
    df = spark.createDataFrame([(i * 7 + (i % 3) * 1000, i) for i in range(50)], "seq long, v long")
    got = [r.ordinal for r in with_ordinal(df, "seq", block=16).orderBy("seq").collect()]
    assert got == list(range(50))
    order = [r.v for r in df.orderBy("seq").collect()]
    prev = [r.p for r in with_previous(df, "seq", "v", "p", F.lit(-1).cast("long"), block=16).orderBy("seq").collect()]
    assert prev == [-1, *order[:-1]]
    assert with_ordinal(df.limit(0), "seq").count() == 0


def test_sparse_numbers_are_spread_over_blocks(spark):
    """Order columns with great gaps: no task sees all rows, whatever the values are."""
    from siltstone.functions import ordinal

    df = spark.range(20_000).select((F.col("id") * F.lit(10**12) - F.lit(5 * 10**15)).alias("seq"), F.col("id").alias("v"))
    tagged = ordinal._in_blocks(df, "seq", 1000)
    sizes = [r["count"] for r in tagged.groupBy("__block").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3000
    got = with_ordinal(df, "seq", block=1000)
    assert got.where("ordinal <> v").count() == 0 and got.count() == 20_000
    assert with_previous(df, "seq", "v", "p", F.lit(-1).cast("long"), block=1000).where("p <> v - 1").count() == 0


def test_cache_replay_follows_gets_puts_and_deletes(spark, collected):
    import random
    from collections import OrderedDict

    r = random.Random(8)
    ops = [(r.choice([0, 1, None]), i, r.choice(["GET", "GET", "PUT", "DELETE", "NOOP", None]), r.choice([None, *"abcdefg"])) for i in range(600)]
    want = []
    for part in (0, 1, None):
        lru, counts = OrderedDict(), [0, 0, 0]
        mine = [o for o in ops if o[0] == part and o[2] in ("GET", "PUT", "DELETE") and o[3] is not None]
        for _, _, op, k in mine:
            if op == "GET":
                counts[0] += 1
                if k in lru:  # a miss does not fill the cache
                    counts[1] += 1
                    lru.move_to_end(k)
            elif op == "DELETE":
                lru.pop(k, None)  # and frees a place
            else:
                lru[k] = 1
                lru.move_to_end(k)
                if len(lru) > 3:
                    lru.popitem(last=False)
                    counts[2] += 1
        want.append((part, *counts, len(lru)))
    df = spark.createDataFrame(ops, "part int, seq long, op string, key string").repartition(5)
    assert collected(cache.replay(df, 3, "part")) == sorted(want, key=repr)
    assert cache.replay(df.limit(0), 3, "part").count() == 0


def test_tombstones_end_tiered_reads(spark, collected):
    rows = [(0, 1, "a", 1, "PUT", "old"), (4, 0, "a", 9, "DELETE", ""), (0, 1, "b", 2, "DELETE", ""), (5, -1, "b", 12, "PUT", "new"), (0, 1, "c", 3, "PUT", "kept"), (0, 1, "d", 3, None, "kept")]
    df = spark.createDataFrame(rows, "run_id long, level int, key string, seq long, op string, value string")
    assert collected(runs.tiered_get(df)) == [("b", -1, 5, 12, "new"), ("c", 1, 0, 3, "kept"), ("d", 1, 0, 3, "kept")]
    assert "a" in {r.key for r in runs.tiered_get(df.drop("op")).collect()}


def test_buffers_are_flushed_when_full(spark, collected):
    rows = [(0, i, k, str(i)) for i, k in enumerate("aabacdaae")] + [(1, i, k, "v") for i, k in enumerate("xyz")] + [(0, 99, None, "v"), (0, None, "k", "v")]
    df = spark.createDataFrame(rows, "part int, seq long, key string, value string")
    got = collected(runs.flush_when_full(df, 3, "part").select("part", "run_id", "key", "seq"))
    assert got == [(0, 0, "a", 3), (0, 0, "b", 2), (0, 0, "c", 4), (0, 1, "a", 7), (0, 1, "d", 5), (0, 1, "e", 8), (1, 0, "x", 0), (1, 0, "y", 1), (1, 0, "z", 2)]


def test_compaction_promotes_over_levels(spark):
    """Merged runs of every level equal merging round by round."""
    df = spark.range(2000).selectExpr("id % 37 as run_id", "concat('k', cast(id % 101 as string)) as key", "id as seq", "cast(id as string) as value").dropDuplicates(["run_id", "key"])
    levels = {0: []}
    for run in range(37):
        held = {r.key: (run, r.seq, r.value) for r in df.where(f"run_id = {run}").collect()} if run < 6 or run % 9 == 0 else None
        levels.setdefault(0, []).append((run, run, held))
        level = 0
        while len(levels[level]) == 4:
            four, levels[level] = levels[level], []
            merged = None if any(x[2] is None for x in four) else {k: v for x in four for k, v in x[2].items()}
            level += 1
            levels.setdefault(level, []).append((four[0][0], four[-1][1], merged))
    got = runs.compact_tiers(df, 37).collect()
    for level, held in levels.items():
        for low, high, keys in held:
            mine = [r for r in got if r.level == level and r.merged_run == low // 4**level]
            assert {r.run_id for r in mine} <= set(range(low, high + 1)) and len({r.key for r in mine}) == len(mine)
            if keys is not None:
                assert {r.key: (r.run_id, r.seq, r.value) for r in mine} == keys


def test_random_sample_and_log_files(spark, tmp_path, collected):
    e = spark.range(1000).selectExpr("cast(id as string) as key", "'v' as value", "id as expiry_ms")
    got = ttl.sample_random(e, 0.02, 3)
    assert 5 <= got.count() <= 60 and got.join(e, "key", "left_anti").count() == 0
    log = spark.createDataFrame([(1, "a", None), (2, None, "x")], "seq long, key string, value string")
    files.write_log(log, str(tmp_path / "log"))
    files.write_log(log, str(tmp_path / "log"))
    assert collected(files.read_log(spark, str(tmp_path / "log"), log.schema)) == sorted([*map(tuple, log.collect())] * 2, key=repr)


def test_checksum(spark):
    df = spark.createDataFrame([(1, 5, "k", "v"), (2, 9, "größe", None)], "seq long, ts_ms long, key string, value string")
    got = {r.seq: r.checksum for r in wal.with_checksum(df).collect()}
    assert got[1] == zlib.crc32((5).to_bytes(8, "big") + b"\x00\x01k" + b"\x00\x01v")
    k = "größe".encode()
    assert got[2] == zlib.crc32((4).to_bytes(8, "big") + len(k).to_bytes(2, "big") + k + b"\x00\x00")
    stored = df.withColumn("checksum", F.when(F.col("seq") == 1, F.lit(got[1])))
    assert {r.seq: r.valid for r in wal.verify_checksum(stored).collect()} == {1: True, 2: None}


@pytest.mark.parametrize("block", [3, 10, 1000])
def test_cache_blocks_equal_one_replay(spark, block):
    import random
    from collections import OrderedDict

    r = random.Random(1)
    keys = [str(r.randint(0, 12)) for _ in range(60)]
    want, lru = 0, OrderedDict()
    for k in keys:
        want += k in lru
        lru.pop(k, None)
        lru[k] = None
        if len(lru) > 5:
            lru.popitem(last=False)
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "seq long, key string")
    got = cache.hits(df, 5, block=block).first()
    assert (got.accesses, got.hits) == (60, want)
    assert {r.key for r in cache.final_content(df, 5).collect()} == set(lru)
    assert tuple(cache.hits(df.limit(0), 5).first()) == (0, 0)


def test_run_files_and_index_text(spark, tmp_path, collected):
    df = spark.createDataFrame([(1, "b", "2"), (1, "a", "1"), (3, "c", "3")], "run_id long, key string, value string")
    files.write_runs(df, str(tmp_path / "runs"))
    (tmp_path / "none").mkdir()
    assert files.recover_catalog(spark, str(tmp_path / "none")).count() == 0
    assert collected(files.recover_catalog(spark, str(tmp_path / "runs"))) == [(1, 0, 2, "b", 4), (3, 0, 1, "c", 4)]
    idx = spark.createDataFrame([("x::||::y", 5), ("k", 0)], "key string, offset long")
    files.write_index_text(idx, str(tmp_path / "idx"))
    assert collected(files.read_index_text(spark, str(tmp_path / "idx"))) == [("k", 0), ("x::||::y", 5)]


def test_route_puts(spark):
    df = spark.createDataFrame([('{"key":"a","value":"1"}',), ('{"key":"b","value":"2","ttl":5}',), ('{"key":"c","ttl":0}',), ("nonsense",), (None,)], "body string")
    assert [(r.key, r.route) for r in state.route_puts(df).collect()] == [("a", "PUT"), ("b", "PUT_TTL"), ("c", "PUT"), (None, "PUT"), (None, "PUT")]


def test_full_merge_is_replay_and_grouping_does_not_matter(spark, data, collected):
    from siltstone.sources.tables import oplog

    plain = oplog(spark, data).where("op <> 'PUT_TTL'")
    r = runs.flush(plain, 50, keep=("op", "value"))
    keep = ("seq", "op", "value")
    whole = collected(runs.merge(r, keep=keep).where("op = 'PUT'").select("key", "value"))
    assert whole == collected(state.live(oplog(spark, data)))
    for size in (2, 3, 5):
        parts = runs.merge(r.withColumn("g", F.floor(F.col("run_id") / size)), "g", keep=keep).drop("g")
        assert collected(runs.merge(parts, keep=keep).where("op = 'PUT'").select("key", "value")) == whole


def test_level_occupancy_counts_all_runs(spark):
    for n in (1, 7, 30, 64):
        ids = spark.range(n).withColumnRenamed("id", "run_id")
        occ = runs.occupancy(runs.tiers(ids, n)).collect()
        assert sum(4**r.level * r.n_runs for r in occ) == n


def test_expired_entries_leave_the_state(spark, tmp_path, collected):
    from siltstone.streaming.oplog import ExpiringState, log_stream

    path, schema = f"file://{tmp_path}/log", "seq long, ts_ms long, op string, key string, value string, expiry_ms long"
    t = ExpiringState(spark, f"file://{tmp_path}/state")
    parts = [[(1, 0, "PUT_TTL", "a", "1", 10), (5, 0, "PUT_TTL", "b", "2", 20), (6, 0, "PUT_TTL", "n", None, None)], [(0, 0, "PUT_TTL", "a", "older", 99), (7, 0, "PUT", "b", "plain", None)], [(8, 0, "PUT_TTL", "a", "again", 50)]]
    seen = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        t.run(log_stream(spark, path))
        t.sweep(10)
        seen.append(collected(t.entries()))
    kept = [("b", "2", 20), ("n", None, None)]
    assert seen == [kept, kept, sorted([("a", "again", 50), *kept], key=repr)]
    t.sweep(20)
    assert t.table.state().where("not is_put and value is null").count() == 1
    t.forget(5)
    assert t.table.state().where("not is_put").count() == 1
    t.forget(6)
    assert t.table.state().where("not is_put").count() == 0 and t.entries().count() == 2


def test_late_and_repeated_batches_of_a_stream(spark, tmp_path, collected):
    from siltstone.streaming.oplog import LatestState, log_stream

    path = f"file://{tmp_path}/log"
    schema = "seq long, ts_ms long, op string, key string, value string, expiry_ms long"
    t = LatestState(spark, f"file://{tmp_path}/state")
    for part in ([(3, 0, "DELETE", "a", "", 0), (4, 0, "PUT", "b", "1", 0)], [(1, 0, "PUT", "a", "x", 0), (4, 0, "PUT", "b", "1", 0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        t.run(log_stream(spark, path))
    assert collected(t.live()) == [("b", "1")]

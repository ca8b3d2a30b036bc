"""Seen keys, distinct counts and frequent items against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import distinct, frequent, seen


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000, 50_000])
def test_filter_has_no_false_negatives_and_few_false_positives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(2**63), 2**63 - 1, n)
    f = seen.PeeledFilter(np.r_[keys, keys])
    assert f.n == len(np.unique(keys)) and f.probe(keys).all()
    others = rng.integers(-(2**63), 2**63 - 1, 200_000)
    assert f.probe(others).mean() < 2e-4
    if n > 1000:
        assert f.slots.nbytes * 8 / n < 22


def records(seed, n=4000):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        key = "hot" if r.random() < 0.35 else r.choice(["", None, "x" * 4000, *map(str, range(1500))])
        out.append((r.choice([1, 2, None]), r.choice([None, *range(400)]), key))
    return out + out[:200]


def test_seen_against_brute_force(spark, tmp_path, collected):
    rec, idx = records(1), records(2, 600)
    schema = "store_id int, run_id long, key string"
    df, other = spark.createDataFrame(rec, schema).withColumn("gen", F.lit("clash")).withColumn("hash", F.lit(1)), spark.createDataFrame(idx, schema)
    first = {}
    for s, r, k in rec + idx:
        if None not in (s, r, k):
            first[s, k] = min(r, first.get((s, k), r))
    want = sorted({x for x in rec if None not in x and x[1] > first[x[0], x[2]]}, key=repr)
    answers = seen.probed(df, other, f"file://{tmp_path}/a")
    assert collected(seen.seen_records(answers)) == want
    report = seen.error_report(answers).collect()
    assert sum(r.probes for r in report) == answers.count() and all(r.wrong <= max(2, 40 * r.stated_rate * r.unseen) for r in report)
    assert max(r.filters for r in report) > 1
    empty = seen.probed(df.limit(0), None, f"file://{tmp_path}/b")
    assert seen.seen_records(empty).count() == 0 and seen.error_report(empty).count() == 0


def test_verify_removes_wrong_answers(spark, tmp_path, collected):
    df = spark.createDataFrame([(1, 0, "a"), (1, 100, "b"), (1, 101, "b"), (1, 200, "a")], "store_id int, run_id long, key string")
    answers = seen.probed(df, None, f"file://{tmp_path}/a").withColumn("seen", F.col("gen") > 0)  # as if every filter said yes
    assert collected(seen.seen_records(answers)) == [(1, 101, "b"), (1, 200, "a")]
    assert sum(r.wrong for r in seen.error_report(answers).collect()) == 1


def test_distinct_against_brute_force(spark):
    r = random.Random(7)
    day = 86_400_000
    rows = [
        (r.choice(["hot", "", None, *map(str, range(60))]), r.choice([None, 0, 1, day - 1, day, 3 * day + 5, 4 * day]), r.choice([1, 2, None]), r.choice([0, 1]))
        for _ in range(1500)
    ]
    df = spark.createDataFrame(rows, "key string, timestamp long, store_id int, level int").withColumn("day", F.lit(3)).withColumn("pattern", F.lit(3))
    members = distinct.memberships(df)
    totals = distinct.patterns(members)
    sets = defaultdict(set)
    for k, t, s, lv in rows:
        if k is None or not t:
            continue
        d = f"1970-01-{1 + t // day:02d}"
        for g in (("day", d, None, None), ("store_id", None, s, None), ("level", None, None, lv), ("day+store_id", d, s, None), ("day+store_id+level", d, s, lv)):
            sets[g].add(k)
    got = distinct.count_by(totals, ("day",), ("store_id",), ("level",), ("day", "store_id"), ("day", "store_id", "level"))
    assert {(x.grouping, x.day, x.store_id, x.level): x.n for x in got.collect()} == {g: len(ks) for g, ks in sets.items()}
    # shards of identifiers add up
    halves = [distinct.patterns(members.where(f"pmod(hash(key), 2) = {h}")) for h in (0, 1)]
    assert {(str(x.pattern), x.n) for x in distinct.merge(*halves).collect()} == {(str(x.pattern), x.n) for x in totals.collect()}
    # any combination of groups
    a, b = sets["level", None, None, 0], sets["level", None, None, 1]
    ask = F.exists("pattern", lambda g: g.level == 0) & ~F.exists("pattern", lambda g: g.level == 1)
    assert distinct.count_where(totals, ask).first().n == len(a - b)
    assert distinct.count_where(totals.limit(0), ask).first().n == 0


def test_jumps(spark, collected):
    day = 86_400_000
    rows = [(f"k{i}", day * d, 1, 0) for d, n in ((1, 8), (2, 13), (3, 20), (5, 40), (8, 7), (9, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, timestamp long, store_id int, level int")
    assert collected(distinct.jumps(distinct.patterns(distinct.memberships(df)))) == [("1970-01-03", 1, -1), ("1970-01-03", 1, 0)]


def zipf_keys(seed, n=60_000, distinct_keys=20_000):
    rng = np.random.default_rng(seed)
    return rng.zipf(1.15, n) % distinct_keys


def test_sketch_bounds():
    s = frequent.HeavyLight(buckets=16, slots=4, cells=256)
    keys = zipf_keys(1)
    mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    for part in np.array_split(mixed, 30):
        s.add(*np.unique(part, return_counts=True))
    true = Counter(mixed.tolist())
    assert s.votes.sum() + s.light.sum() == len(keys)
    for h, n in zip(s.value[s.votes > 0], s.votes[s.votes > 0]):
        assert n <= true[int(h)]
    held = {int(h): int(n) for h, n in zip(s.value[s.votes > 0], s.votes[s.votes > 0])}
    for h, n in true.items():
        cell = s.cell(np.array([h]))[0]
        assert n <= held.get(h, 0) + s.light[cell]


def test_merge_keeps_bounds():
    keys = (zipf_keys(2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    whole = frequent.HeavyLight(16, 4, 256)
    for part in np.array_split(keys, 5):
        s = frequent.HeavyLight(16, 4, 256)
        s.add(*np.unique(part, return_counts=True))
        whole.merge(s.value, s.votes, s.partial, s.against, s.light)
    true = Counter(keys.tolist())
    held = {int(h): (int(n), bool(p)) for h, n, p in zip(whole.value.ravel(), whole.votes.ravel(), whole.partial.ravel()) if n}
    assert sum(n for n, _ in held.values()) + whole.light.sum() == len(keys)
    for h, n in true.items():
        low, part = held.get(h, (0, True))
        assert low <= n <= low + (whole.light[whole.cell(np.array([h]))[0]] if part else 0)


@pytest.mark.parametrize("shape", [(2048, 8, 65_536), (16, 1, 65_536), (16, 2, 64)])
def test_most_frequent_is_exact(spark, shape):
    """Far too small a sketch must still lead to the right keys, through the light cells."""
    keys = [str(k) for k in zipf_keys(3, 20_000, 3000)]
    df = spark.createDataFrame([(k,) for k in [*keys, None, None, ""]], "key string").repartition(6).withColumn("n", F.lit(0)).withColumn("cell", F.lit(0))
    want = sorted(Counter([*keys, ""]).items(), key=lambda x: (-x[1], x[0]))[:30]
    got = frequent.most_frequent(df, 30, shape).collect()
    assert [(r.key, r.n) for r in got] == want
    assert all(r.approx_n >= r.n for r in got)


def test_most_frequent_of_few_and_none(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "key string")
    assert [(r.key, r.n) for r in frequent.most_frequent(df, 30).collect()] == [("a", 2), ("b", 1)]
    assert frequent.most_frequent(df.limit(0), 30).count() == 0
    assert [(r.key, r.n) for r in frequent.most_frequent(df, 1).collect()] == [("a", 2)]


def test_one_key_in_thousands_of_groups(spark):
    """Groups of one pattern are made distinct in linear time: twice the groups take about twice as long."""
    import time

    def took(groups):
        members = spark.range(groups).selectExpr("'k' as key", "cast(date_add(date'2026-01-01', cast(id % 50 as int)) as string) as day", "cast(id div 50 as int) as store_id", "1 as level")
        counts = distinct.count_by(distinct.patterns(members), ("day",), ("store_id",), ("day", "store_id", "level"))
        best = None
        for _ in range(3):
            t = time.perf_counter()
            rows = counts.collect()
            best = min(best or 1e9, time.perf_counter() - t)
        assert len(rows) == 50 + groups // 50 + groups and all(r.n == 1 for r in rows)
        return best

    assert took(40_000) < 4 * took(20_000) + 1


def test_a_later_batch_reads_filters_only(spark, tmp_path, collected):
    import shutil

    path = tmp_path / "seen"
    keys = seen.SeenKeys(spark, f"file://{path}")
    schema = "store_id int, run_id long, key string"
    first = spark.createDataFrame([(s, r, f"k{s}-{r % 50}") for s in (1, 2) for r in range(300)], schema)
    a = keys.apply(first)
    assert a.where("not seen").count() == 100
    # nothing of the first batch is left but its filters
    kept = {f.name for f in path.glob("batch-*/sealed=true/*.parquet")}
    for f in path.glob("batch-*/sealed=false"):
        shutil.rmtree(f)
    bits = sum((path / f.parent.parent.name / f.parent.name / f.name).stat().st_size for f in path.glob("batch-*/sealed=true/*.parquet"))
    assert kept and bits < 64_000
    second = spark.createDataFrame([(1, 300, "k1-7"), (1, 301, "k2-7"), (2, 400, "k2-7"), (2, 401, "fresh"), (1, 999, "fresh"), (1, 999, "fresh"), (1, 1000, None)], schema)
    b = {(r.store_id, r.key): r.seen for r in keys.apply(second, None).collect()}
    assert b == {(1, "k1-7"): True, (1, "k2-7"): False, (2, "k2-7"): True, (2, "fresh"): False, (1, "fresh"): False}
    with pytest.raises(ValueError):
        keys.apply(second)
    assert keys.apply(second.limit(0)).count() == 0
    third = keys.apply(spark.createDataFrame([(1, 2000, "fresh"), (3, 2000, "fresh")], schema))
    assert {(r.store_id, r.seen) for r in third.collect()} == {(1, True), (3, False)}
    assert {r.filters for r in third.collect()} <= set(range(1, 12))


def test_sketches_of_many_splits_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(frequent, "FAN_IN", 3)
    r = random.Random(4)
    rows = [(f"hot{r.randint(0, 20)}",) if r.random() < 0.5 else (f"k{r.randint(0, 5000)}",) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "key string").repartition(40)
    want = sorted(Counter(k for k, in rows).items(), key=lambda x: (-x[1], x[0]))[:20]
    got = frequent.most_frequent(df, 20, (64, 4, 256)).collect()
    assert sorted(((x.key, x.n) for x in got), key=lambda x: (-x[1], x[0])) == want

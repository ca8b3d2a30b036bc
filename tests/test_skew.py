import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import skew


def test_against_brute_force(spark):
    r = random.Random(5)
    rows = [("hot" if r.random() < 0.5 else r.choice(["a", "", None, "z" * 3000]), r.choice([None, "", "x", "yy", "zzz" * 10])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "key string, value string").withColumn("weight", F.lit(7)).withColumn("n", F.lit(7))
    w = skew.compress(df, ("key",), F.col("value"))
    assert w.count() <= 25
    got = {x.key: x for x in skew.summarise(w, ("key",)).collect()}
    pct = {x.key: x for x in skew.percentiles(w, ("key",), F.length("value")).collect()}
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    for k, vs in by.items():
        known = [v for v in vs if v is not None]
        c = Counter(known)
        top = max(c.values())
        mode = min(v for v, n in c.items() if n == top)
        assert (got[k].n, got[k].n_values, got[k].mode, got[k].mode_weight) == (len(vs), len(c), mode, top)
        assert np.isclose(pct[k].p50, np.percentile([len(v) for v in known], 50))
        assert np.isclose(pct[k].p90, np.percentile([len(v) for v in known], 90))


def test_empty_and_only_null_values(spark):
    df = spark.createDataFrame([], "key string, value string")
    assert skew.summarise(skew.compress(df, ("key",), F.col("value")), ("key",)).count() == 0
    one = spark.createDataFrame([("k", None)], df.schema)
    r = skew.summarise(skew.compress(one, ("key",), F.col("value")), ("key",)).first()
    assert (r.n, r.n_values, r["mode"], r.mode_weight) == (1, 0, None, None)


def test_heavy_keys_counts_null_keys_in_the_total(spark):
    s = spark.createDataFrame([("t", "a", 2), ("t", "b", 1), ("t", None, 97)], "table_name string, key string, n long")
    totals = spark.createDataFrame([("t", 100)], "table_name string, total long")
    assert [r.key for r in skew.heavy_keys(s, totals, 0.02).collect()] == ["a"]
    for n in range(1, 60):  # just the share, whatever the number
        one = spark.createDataFrame([("t", "a", n), ("t", "b", n - 1)], "table_name string, key string, n long")
        if n % 10 in (1, 7):
            assert [r.key for r in skew.heavy_keys(one, spark.createDataFrame([("t", 50 * n)], "table_name string, total long"), 0.02).collect()] == ["a"]

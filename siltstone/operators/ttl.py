"""Expiring entries: the map of PUT_TTL mutations, read-time expiry and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values
SAMPLE_SIZE = 20
TRIGGER = 5


def entries(log: DataFrame) -> DataFrame:
    """Latest expiring put of each key: key, value, expiry_ms. Plain puts and deletes do not touch this map."""
    ttl = log.where((F.col("op") == "PUT_TTL") & F.col("key").isNotNull())
    return ttl.groupBy("key").agg(F.max(F.struct("seq", "value", "expiry_ms")).alias("last")).select("key", "last.value", "last.expiry_ms")


def from_store(table: DataFrame) -> DataFrame:
    """Stored entries (store_id, key, value, TTL, expiryTime) as one entry per key of a store: store_id, key, value, expiry_ms.

    An entry expires only if its flag is set and its time is neither null nor 0; else expiry_ms is null. The table has no order, so of several entries of a
    key the one that lives longest counts, and among equals the greater value, null least. Rows without store or key are no entries; repeated rows change nothing.
    """
    expiry = F.when(F.col("TTL") & (F.col("expiryTime") != 0), F.col("expiryTime"))
    best = F.max(F.struct(expiry.isNull().alias("never"), expiry.alias("expiry_ms"), F.col("value").isNotNull().alias("known"), "value"))
    kept = table.na.drop(subset=["store_id", "key"]).groupBy("store_id", "key").agg(best.alias("w"))
    return kept.select("store_id", "key", "w.value", "w.expiry_ms")


def live_at(ttl: DataFrame, now_ms: int) -> DataFrame:
    """Entries a read at ``now_ms`` sees: expired only if now > expiry. A null expiry never expires."""
    return ttl.where(F.coalesce(F.lit(now_ms) <= F.col("expiry_ms"), F.lit(True)))


def sweep_counts(ttl: DataFrame, now_ms: int) -> DataFrame:
    """How many entries a full sweep removes (now >= expiry) and keeps."""
    return ttl.select(F.coalesce(F.lit(now_ms) >= F.col("expiry_ms"), F.lit(False)).alias("expired")).groupBy("expired").agg(F.count("*").alias("n"))


def sample(ttl: DataFrame, size: int = SAMPLE_SIZE) -> DataFrame:
    """A repeatable sample: the ``size`` entries with the least MD5 of their keys (a top-k, no global sort)."""
    return ttl.withColumn("rank_hash", F.md5("key")).orderBy("rank_hash", "key").limit(size)


def sample_random(ttl: DataFrame, fraction: float, seed: int) -> DataFrame:
    """A random sample with replacement, as the background sweep draws it."""
    return ttl.sample(withReplacement=True, fraction=fraction, seed=seed)


def triggers(sampled: DataFrame, now_ms: int) -> DataFrame:
    """One row: whether the sample's expired entries call for a full sweep. An empty sample does not."""
    expired = F.count_if(F.lit(now_ms) >= F.col("expiry_ms"))
    return sampled.agg(F.count("*").alias("sampled"), expired.alias("expired")).withColumn("sweep", F.col("expired") >= TRIGGER)

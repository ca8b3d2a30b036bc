"""Write-ahead log: delta times, group commit, checksums, tails and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.ordinal import whole_div, with_ordinal, with_previous
from siltstone.operators.state import latest

GROUP = 200


def deltas(log: DataFrame) -> DataFrame:
    """seq, delta to the entry before (the first holds its full time) and the stored 32-bit value."""
    d = with_previous(log.select("seq", "ts_ms"), "seq", "ts_ms", "prev", F.lit(0).cast("long"))
    delta = F.col("ts_ms") - F.col("prev")
    return d.select("seq", delta.alias("delta"), delta.bitwiseAND(F.lit(4294967295)).alias("stored"))


def batches(log: DataFrame, size: int = GROUP) -> DataFrame:
    """Group commits of ``size`` entries: batch_id, n, first and last seq."""
    b = with_ordinal(log.select("seq"), "seq").withColumn("batch_id", whole_div("ordinal", size))
    return b.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def _utf(s: Column) -> Column:
    """Two-byte length and UTF-8 bytes."""
    b = F.encode(F.coalesce(s, F.lit("")), "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(b)), 4, "0")), b)


def with_checksum(log: DataFrame) -> DataFrame:
    """seq and the CRC-32 of [int64 delta][key][value], strings with their two-byte lengths. A null value counts as empty."""
    d = with_previous(log.select("seq", "ts_ms", "key", "value"), "seq", "ts_ms", "prev", F.lit(0).cast("long"))
    delta = F.col("ts_ms") - F.col("prev")
    payload = F.concat(F.unhex(F.lpad(F.hex(delta), 16, "0")), _utf(F.col("key")), _utf(F.col("value")))
    return d.select("seq", F.crc32(payload).alias("checksum"))


def verify_checksum(log: DataFrame) -> DataFrame:
    """seq and whether the stored ``checksum`` is right; null where none is stored."""
    stored = log.select("seq", F.col("checksum").alias("stored"))
    return with_checksum(log).join(stored, "seq").select("seq", (F.col("checksum") == F.col("stored")).alias("valid"))


def tail(log: DataFrame, ops_per_run: int) -> DataFrame:
    """Entries after the last full run, which a truncation must keep."""
    cut = with_ordinal(log, "seq").withColumn("__run", whole_div("ordinal", ops_per_run))
    full = cut.groupBy("__run").agg(F.count("*").alias("n"), F.max("seq").alias("last")).where(F.col("n") == ops_per_run)
    flushed = full.agg(F.coalesce(F.max("last"), F.lit(-(2**63) + 1)).alias("flushed_seq")).withColumn("__one", F.lit(1))
    return log.withColumn("__one", F.lit(1)).join(F.broadcast(flushed), "__one").where(F.col("seq") > F.col("flushed_seq")).drop("__one", "flushed_seq")


def compact(log: DataFrame) -> DataFrame:
    """Full last entry of each key whose last entry is a put: key, seq, ts_ms, op, value."""
    plain = log.where(F.col("op").isin("PUT", "DELETE"))
    return latest(plain, keep=("ts_ms", "op", "value")).where(F.col("op") == "PUT")

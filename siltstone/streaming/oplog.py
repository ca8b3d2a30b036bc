"""Mutation logs as streams: current state and live expiring entries, kept up batch by batch in change tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.changes import ChangeTable

LOG = "seq long, ts_ms long, op string, key string, value string, expiry_ms long"
_ENTRY = "value string, expiry_ms long"


def log_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of log entries in Parquet files; each file is read once."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", str(files_per_batch)).parquet(path)


def _as_changes(entries: DataFrame, is_put, value) -> DataFrame:
    """Entries of one log as changes of one store; ``seq`` is the whole order."""
    return entries.select(F.lit(0).alias("store_id"), "key", F.lit(0).alias("wal_gen"), "seq", is_put.alias("is_put"), value.alias("value"))


class LatestState:
    """Last entry of each key, in a change table: a batch rewrites only the groups its keys lie in.

    A repeated batch changes nothing. Deletes stay in the state as entries, which makes late entries harmless, until ``forget`` is told
    that none come any more. Entries with a null key, seq or op are no mutations.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.table, self.path = ChangeTable(spark, f"{path}/table", values=True), path

    def live(self) -> DataFrame:
        return self.table.live().select("key", "value")

    def run(self, stream: DataFrame) -> None:
        """Apply what is there and stop; a later call goes on from the checkpoint."""
        plain = stream.where(F.col("op").isin("PUT", "DELETE"))
        self.table.follow(_as_changes(plain, F.col("op") == "PUT", F.col("value")), f"{self.path}/checkpoint")

    def forget(self, seq: int) -> None:
        """Drop the deletes before ``seq``: no entry before it will come any more."""
        self.table.forget(0, seq)


class ExpiringState:
    """Latest expiring put of each key, in a change table of its own.

    ``sweep`` turns entries that have expired into tombstones without value at their own place in the order, so that a late older put does not bring
    them back, and ``forget`` drops those tombstones: the state holds live entries and what may still be contradicted.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.table, self.path = ChangeTable(spark, f"{path}/table", values=True), path

    def run(self, stream: DataFrame) -> None:
        ttl = stream.where(F.col("op") == "PUT_TTL")
        self.table.follow(_as_changes(ttl, F.lit(True), F.to_json(F.struct("value", "expiry_ms"))), f"{self.path}/checkpoint")

    def _entries(self) -> DataFrame:
        return self.table.live().select("key", "seq", F.from_json("value", _ENTRY).alias("e")).select("key", "seq", "e.value", "e.expiry_ms")

    def entries(self) -> DataFrame:
        return self._entries().drop("seq")

    def sweep(self, now_ms: int) -> None:
        """Remove what has expired (now >= expiry). A null expiry never expires."""
        gone = self._entries().where(F.col("expiry_ms") <= now_ms)
        self.table.apply(_as_changes(gone, F.lit(False), F.lit(None).cast("string")))

    def forget(self, seq: int) -> None:
        self.table.forget(0, seq)

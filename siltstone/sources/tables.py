"""Readers of the given tables and of the operation logs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import table_path

LOG_ENTRY = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("checksum", T.LongType()),
    ]
)
RUN_RECORD = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("isTombstone", T.BooleanType()),
    ]
)
INDEX_ENTRY = T.StructType([T.StructField("key", T.StringType()), T.StructField("offset", T.LongType())])
PUT_BODY = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("ttl", T.LongType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutation log of the ``events`` table: seq, ts_ms, op, key, value, expiry_ms.

    Errors are deletes, sign-ups expiring puts, all other events puts.
    """
    e = table(spark, sf_dir, "events")
    ts_ms = F.unix_millis(F.col("ts").cast("timestamp"))
    op = F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "signup", "PUT_TTL").otherwise("PUT")
    return e.select(
        F.col("event_id").alias("seq"),
        ts_ms.alias("ts_ms"),
        op.alias("op"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.col("event_type"), F.lit(":"), F.col("props"))).alias("value"),
        (ts_ms + F.lit(3600000) * (1 + F.col("event_id") % 240)).alias("expiry_ms"),
    )


def olog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put-only log of the ``orders`` table: seq, key, value."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"),
        F.concat(F.col("o_orderstatus"), F.lit("|"), F.col("o_orderpriority")).alias("value"),
    )


def requests(spark: SparkSession) -> DataFrame:
    """Forty lookup keys, hits and misses mixed."""
    return spark.range(40).select(F.concat(F.lit("user:"), (F.col("id") * 7).cast("string")).alias("key"))

"""Sinks and readers of run files, run catalogues, text indexes and delimited logs.

A run is a set of Parquet files sorted by key in a folder ``run_id=N``; row-group
minima and maxima, and a Parquet Bloom filter on the key, take the place of the
sparse index and of the filter kept beside each run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_DELIMITER = "::||::"


def write_runs(runs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write records with a ``run_id`` as sorted runs, one folder a run.

    Rows are shuffled once by run, and a run too large for one task is divided by key range
    through the second sort column, since the range partitioner splits on (run_id, key).
    """
    (
        runs.repartitionByRange("run_id", "key")
        .sortWithinPartitions("run_id", "key")
        .write.mode(mode)
        .option("parquet.bloom.filter.enabled#key", "true")
        .option("parquet.enable.dictionary", "false")
        .partitionBy("run_id")
        .parquet(path)
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Records of all runs in a folder, with their run_id as a long."""
    return spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("long"))


def recover_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Runs found in storage: run_id, level (0, as after a restart), n_records, and the next run id.

    An empty folder gives no rows. Duplicate files of a run count together.
    """
    found = spark.read.schema("key string, run_id long").parquet(path)
    runs = found.groupBy("run_id").agg(F.count("*").alias("n_records"), F.max("key").alias("max_key"))
    # the maximum is one row; partition discovery makes it a scan of file names
    top = found.agg((F.max("run_id") + 1).alias("next_run_id"))
    return runs.withColumn("one", F.lit(1)).join(F.broadcast(top.withColumn("one", F.lit(1))), "one").select(
        "run_id", F.lit(0).alias("level"), "n_records", "max_key", "next_run_id"
    )


def write_index_text(index: DataFrame, path: str) -> None:
    """Write (key, offset) as text lines ``key::||::offset``."""
    index.select(F.concat_ws(INDEX_DELIMITER, "key", F.col("offset").cast("string")).alias("value")).write.mode("overwrite").text(path)


def read_index_text(spark: SparkSession, path: str) -> DataFrame:
    """Parse text index lines; the last delimiter of a line counts, so keys may contain it."""
    line = F.col("value")
    return spark.read.text(path).select(
        F.regexp_extract(line, r"^(.*)::\|\|::(-?\d+)$", 1).alias("key"),
        F.regexp_extract(line, r"^(.*)::\|\|::(-?\d+)$", 2).cast("long").alias("offset"),
    )


def write_log(log: DataFrame, path: str) -> None:
    """Write a mutation log as JSON lines."""
    log.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)

"""Queries of the general pipeline problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import changes, skew
from siltstone.session import table_path, work_dir
from siltstone.sources.tables import table
from siltstone.streaming.compactor import Compactor, catalogue, remap_index


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Live keys of each store with the change that set them, through a published change table."""
    feed = changes.from_log(table(spark, d, "log_entry")).unionByName(changes.from_runs(table(spark, d, "sst_write")))
    target = changes.ChangeTable(spark, work_dir(spark, "changes"))
    target.apply(feed)
    return target.live().select("store_id", "key", "wal_gen", "seq")


def p1_state(spark: SparkSession, d: str) -> DataFrame:
    """The rebuilt tables: live keys of each store with their values."""
    feed = changes.from_log(table(spark, d, "log_entry")).unionByName(changes.from_runs(table(spark, d, "sst_write")))
    target = changes.ChangeTable(spark, work_dir(spark, "changes"), values=True)
    target.apply(feed)
    return target.live()


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    named = [table(spark, d, t).select(F.lit(t).alias("table_name"), "key", "value") for t in ("log_entry", "sst_write")]
    return named[0].unionByName(named[1])


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    return skew.compress(_keyed(spark, d), ("table_name", "key"), F.col("value"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys with at least 2 percent of a table's rows."""
    totals = _keyed(spark, d).groupBy("table_name").agg(F.count("*").alias("total"))  # reads no column
    return skew.heavy_keys(skew.summarise(_weighted(spark, d), ("table_name", "key")), totals, 0.02).select("table_name", "key")


def p3_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Per table and key: rows, distinct values, mode, and percentiles of the value's length."""
    by = ("table_name", "key")
    weighted = _weighted(spark, d).where(F.col("key").isNotNull())
    points = skew.percentiles(weighted, by, F.octet_length("value"))
    return skew.summarise(weighted, by).join(points, list(by), "left")


def _compacted(spark: SparkSession, d: str) -> Compactor:
    source = table_path(d, "sst_write")
    c = Compactor(spark, source, work_dir(spark, "compacted"), spark.read.parquet(source).schema)
    c.run()
    return c


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every record of the consolidated data."""
    return _compacted(spark, d).records().select("store_id", "run_id", "key")


def p4_index(spark: SparkSession, d: str) -> DataFrame:
    """The sparse index over the consolidated files."""
    return remap_index(table(spark, d, "index_entry"), _compacted(spark, d).locations())


def p4_index_keys(spark: SparkSession, d: str) -> DataFrame:
    """Which records the index over the consolidated files leads to, and to how many places each."""
    return p4_index(spark, d).groupBy("store_id", "run_id", "key").agg(F.count("*").alias("n_places"))


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """What became of each catalogued file."""
    return catalogue(table(spark, d, "run_file"), table(spark, d, "sst_write"))


QUERIES = {f.__name__: f for f in (p1_found, p1_state, p3_found, p3_per_key, p4_found, p4_index, p4_index_keys, p4_files)}

ORACLE: dict[str, str] = {
    "p1_found": """WITH c AS (
        SELECT store_id, key, wal_gen, seq, CASE WHEN upper(trim(op)) IN ('PUT','0') THEN true WHEN upper(trim(op)) IN ('DELETE','DEL','1') THEN false END AS put FROM log_entry
        UNION ALL SELECT store_id, key, wal_gen, seq, isTombstone IS NOT TRUE FROM sst_write),
      r AS (SELECT *, row_number() OVER (PARTITION BY store_id, key ORDER BY wal_gen DESC, seq DESC, put) AS rn FROM c WHERE put IS NOT NULL AND key IS NOT NULL)
      SELECT store_id, key, wal_gen, seq FROM r WHERE rn=1 AND put""",
    "p1_state": """WITH c AS (
        SELECT store_id, key, wal_gen, seq, CASE WHEN upper(trim(op)) IN ('PUT','0') THEN true WHEN upper(trim(op)) IN ('DELETE','DEL','1') THEN false END AS put, value FROM log_entry
        UNION ALL SELECT store_id, key, wal_gen, seq, isTombstone IS NOT TRUE, value FROM sst_write),
      r AS (SELECT *, row_number() OVER (PARTITION BY store_id, key ORDER BY wal_gen DESC, seq DESC, put, value DESC NULLS LAST) AS rn FROM c WHERE put IS NOT NULL AND key IS NOT NULL)
      SELECT store_id, key, wal_gen, seq, value FROM r WHERE rn=1 AND put""",
    "p3_found": """WITH t AS (SELECT 'log_entry' AS table_name, key FROM log_entry UNION ALL SELECT 'sst_write', key FROM sst_write),
      n AS (SELECT table_name, key, count(*) AS n FROM t GROUP BY 1,2), s AS (SELECT table_name, count(*) AS total FROM t GROUP BY 1)
      SELECT table_name, key FROM n JOIN s USING (table_name) WHERE key IS NOT NULL AND n >= 0.02*total""",
    "p3_per_key": """WITH t AS (SELECT 'log_entry' AS table_name, key, value FROM log_entry UNION ALL SELECT 'sst_write', key, value FROM sst_write),
      a AS (SELECT table_name, key, count(*) AS n, count(DISTINCT value) AS n_values, quantile_cont(strlen(value)::DOUBLE, 0.5) AS p50, quantile_cont(strlen(value)::DOUBLE, 0.9) AS p90 FROM t WHERE key IS NOT NULL GROUP BY 1,2),
      v AS (SELECT table_name, key, value, count(*) AS c FROM t WHERE key IS NOT NULL AND value IS NOT NULL GROUP BY 1,2,3),
      m AS (SELECT table_name, key, value AS mode, c AS mode_weight FROM (SELECT *, row_number() OVER (PARTITION BY table_name, key ORDER BY c DESC, value) AS rn FROM v) WHERE rn=1)
      SELECT a.*, m.mode, m.mode_weight FROM a LEFT JOIN m USING (table_name, key)""",
    "p4_files": """WITH r AS (SELECT file_id, count(DISTINCT (store_id, run_id, key)) AS n FROM sst_write WHERE key IS NOT NULL AND store_id IS NOT NULL AND run_id IS NOT NULL GROUP BY 1)
      SELECT f.file_id, f.store_id, f.run_id, coalesce(r.n, 0) AS n_found, CASE WHEN r.n > 0 THEN 'absorbed' WHEN archived_at IS NOT NULL THEN 'archived' ELSE 'empty' END AS fate
      FROM run_file f LEFT JOIN r USING (file_id)""",
    "p4_index_keys": """SELECT store_id, run_id, key, 1::BIGINT AS n_places FROM (SELECT DISTINCT store_id, run_id, key FROM index_entry WHERE key IS NOT NULL AND store_id IS NOT NULL AND run_id IS NOT NULL)
      SEMI JOIN sst_write USING (store_id, run_id, key)""",
    "p4_found": "SELECT DISTINCT store_id, run_id, key FROM sst_write WHERE key IS NOT NULL AND store_id IS NOT NULL AND run_id IS NOT NULL",
}

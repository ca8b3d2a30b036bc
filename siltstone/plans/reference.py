"""Named queries over the derived logs. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.hashing import bit_position, fnv_hash, mix_hash, sha_hash, with_bits
from siltstone.functions.ordinal import whole_div
from siltstone.functions.units import to_millis
from siltstone.operators import cache, probe, runs, state, ttl, wal
from siltstone.session import work_dir
from siltstone.sources import files
from siltstone.sources.tables import olog, oplog, requests, table
from siltstone.streaming.oplog import LOG, ExpiringState, LatestState, log_stream

NOW_MS = 1705276800000
STORED_NOW_MS = 1768700000000
RUN_OPS = 1000
DELETE_RUN_OPS = 50
CACHE_KEYS = 50
PARTS, CACHE_PART_KEYS, BUFFER_KEYS = 8, 30, 50

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def kv_latest(s, d):
    return state.live(oplog(s, d))


@query
def kv_multi_get(s, d):
    return state.multi_get(requests(s), state.live(oplog(s, d)))


@query
def kv_get(s, d):
    return state.get(state.live(oplog(s, d)), "user:14")


@query
def kv_get_json(s, d):
    return state.as_json(state.multi_get(requests(s), state.live(oplog(s, d))))


@query
def kv_range(s, d):
    return state.key_range(state.live(oplog(s, d)), "user:1", "user:5")


@query
def put_router(s, d):
    log = oplog(s, d)
    body = F.to_json(F.struct("key", "value", F.when(F.col("op") == "PUT_TTL", F.col("expiry_ms") - F.col("ts_ms")).alias("ttl")))
    return state.route_puts(log.where("op <> 'DELETE'").select("seq", body.alias("body"))).select("seq", "route", "key", "value", "ttl")


def _ttl(s, d):
    return ttl.entries(oplog(s, d))


@query
def ttl_live(s, d):
    return ttl.live_at(_ttl(s, d), NOW_MS)


@query
def ttl_sweep(s, d):
    return ttl.sweep_counts(_ttl(s, d), NOW_MS)


@query
def ttl_stored_live(s, d):
    """Entries of the stored table that a read sees."""
    return ttl.live_at(ttl.from_store(table(s, d, "ttl_entry")), STORED_NOW_MS)


@query
def ttl_stored_sweep(s, d):
    return ttl.sweep_counts(ttl.from_store(table(s, d, "ttl_entry")), STORED_NOW_MS)


@query
def ttl_sample(s, d):
    return ttl.sample(_ttl(s, d)).select("key", "expiry_ms")


@query
def ttl_trigger(s, d):
    return ttl.triggers(ttl.sample(_ttl(s, d)), NOW_MS)


@query
def ttl_units(s, d):
    unit = F.element_at(F.array(*map(F.lit, ("SECONDS", "MINUTES", "HOURS", "DAYS"))), (F.col("seq") % 4 + 1).cast("int"))
    amount = 1 + F.col("seq") % 240
    return oplog(s, d).select("seq", unit.alias("unit"), amount.alias("amount"), to_millis(amount, unit).alias("millis"))


def _runs(s, d):
    return runs.flush(olog(s, d), RUN_OPS)


def _plain(s, d):
    return oplog(s, d).where("op <> 'PUT_TTL'")


def _op_runs(s, d):
    return runs.flush(_plain(s, d), RUN_OPS, keep=("op", "value"))


@query
def run_flush(s, d):
    return runs.run_summary(_runs(s, d))


@query
def run_catalog(s, d):
    path = work_dir(s, "runs")
    files.write_runs(_runs(s, d), path)
    return files.recover_catalog(s, path)


@query
def wal_tail(s, d):
    return wal.tail(olog(s, d), 1024).select("seq", "key", "value")


@query
def compact_newest(s, d):
    return runs.merge(_runs(s, d).withColumn("grp", whole_div("run_id", 4)), "grp")


@query
def compact_oldest(s, d):
    return runs.merge(_runs(s, d).withColumn("grp", whole_div("run_id", 4)), "grp", newest=False)


@query
def compact_purge(s, d):
    return runs.merge_tiers(_op_runs(s, d))


def _flushes(log):
    """Number of the last run, the write buffer, i.e. of the flushes before it; from file footers."""
    return max(0, log.count() - 1) // RUN_OPS


def _membership(s, d):
    n = _flushes(olog(s, d)) + 1
    return runs.tiers(_runs(s, d).select("run_id").distinct(), n)


@query
def tier_membership(s, d):
    return _membership(s, d)


@query
def tier_levels(s, d):
    return runs.occupancy(_membership(s, d))


@query
def compact_tiers(s, d):
    return runs.compact_tiers(_runs(s, d), _flushes(olog(s, d)) + 1)


@query
def compact_files(s, d):
    """Runs written to run files, read back and merged."""
    path = work_dir(s, "runs")
    files.write_runs(_runs(s, d), path)
    return runs.merge(files.read_runs(s, path).withColumn("grp", whole_div("run_id", 4)), "grp")


def _stored(s, r):
    """Runs are files: written once, read by every part of a query."""
    path = work_dir(s, "runs")
    r.write.parquet(path)
    return s.read.parquet(path)


def _tiered(r, buffer):
    """Runs with their level; the last run is the write buffer, level -1."""
    return r.withColumn("level", F.when(F.col("run_id") == buffer, -1).otherwise(runs.level_of("run_id", buffer)))


@query
def tiered_get(s, d):
    return runs.tiered_get(_tiered(_runs(s, d), _flushes(olog(s, d))))


@query
def tiered_get_as_coded(s, d):
    return runs.tiered_get(_tiered(_runs(s, d), _flushes(olog(s, d))), newest=False)


@query
def tiered_get_deleted(s, d):
    """Tiered reads over runs that hold tombstones."""
    return runs.tiered_get(_tiered(_op_runs(s, d), _flushes(_plain(s, d))))


@query
def run_flush_full(s, d):
    """Runs of buffers that are flushed when they hold BUFFER_KEYS different keys, one buffer a part of the keys."""
    log = olog(s, d).withColumn("part", F.pmod(F.substring_index("key", ":", -1).cast("long"), F.lit(PARTS)).cast("int"))
    cut = runs.flush_when_full(log, BUFFER_KEYS, "part")
    return cut.groupBy("part", "run_id").agg(F.count("*").alias("n_entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("seq").alias("max_seq"))


@query
def kv_as_coded_delete(s, d):
    return runs.as_coded_deletes(oplog(s, d), DELETE_RUN_OPS)


def _hash_query(name, f):
    def q(s, d):
        keys = olog(s, d).select("key").distinct()
        return keys.select("key", f(F.col("key")).alias("hash"), bit_position(f(F.col("key"))).alias("bit"))

    q.__name__ = name
    query(q)


_hash_query("bloom_sha", sha_hash)
_hash_query("bloom_fnv", fnv_hash)
_hash_query("bloom_mur", mix_hash)


def _run_files(s, d):
    """Run files whose records hold their filter bits, as the writer of a run has them."""
    return _stored(s, with_bits(_runs(s, d)))


@query
def bloom_build(s, d):
    return probe.filter_bits(_runs(s, d))


def _next_keys(r):
    """Keys of each run asked in the run before it."""
    return r.where("run_id > 0").withColumn("run_id", F.col("run_id") - 1)


@query
def bloom_probe(s, d):
    r = _run_files(s, d)
    return probe.probe_filters(_next_keys(r), probe.filters(r))


@query
def sparse_index(s, d):
    return probe.sparse_index(_runs(s, d))


@query
def index_text(s, d):
    """The sparse index of run 0 as text lines and back."""
    path = work_dir(s, "index")
    files.write_index_text(probe.sparse_index(_runs(s, d).where("run_id = 0")), path)
    return files.read_index_text(s, path)


@query
def index_floor(s, d):
    r = _stored(s, _runs(s, d))
    return probe.index_floor(_next_keys(r), probe.sparse_index(r))


@query
def run_probe(s, d):
    r = _run_files(s, d)
    return probe.point_reads(_next_keys(r), r, probe.filters(r), probe.sparse_index(r))


@query
def wal_delta(s, d):
    return wal.deltas(oplog(s, d))


@query
def wal_batches(s, d):
    return wal.batches(oplog(s, d))


@query
def wal_crc(s, d):
    return wal.with_checksum(oplog(s, d))


@query
def log_compact(s, d):
    return wal.compact(oplog(s, d))


@query
def lru_final(s, d):
    return cache.final_content(olog(s, d), 500)


@query
def lru_hits(s, d):
    return cache.hits(oplog(s, d), CACHE_KEYS)


@query
def lru_ops(s, d):
    """Caches of CACHE_PART_KEYS keys, one a part of the users: views are gets, errors deletes, all other events puts."""
    e = table(s, d, "events")
    op = F.when(F.col("event_type") == "view", "GET").when(F.col("event_type") == "error", "DELETE").otherwise("PUT")
    ops = e.select(F.pmod("user_id", F.lit(PARTS)).cast("int").alias("part"), F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("key"))
    return cache.replay(ops, CACHE_PART_KEYS, "part")


@query
def log_replay(s, d):
    """State of a log that was written as JSON lines and read back."""
    path = work_dir(s, "log")
    files.write_log(oplog(s, d), path)
    return state.live(files.read_log(s, path, LOG))


def _log_files(s, d):
    """The log written as several files, as a stream source."""
    path = work_dir(s, "log")
    oplog(s, d).repartitionByRange(4, "seq").write.parquet(path)
    return log_stream(s, path, files_per_batch=2)


@query
def stream_latest(s, d):
    target = LatestState(s, work_dir(s, "latest"))
    target.run(_log_files(s, d))
    return target.live()


@query
def stream_ttl_live(s, d):
    target = ExpiringState(s, work_dir(s, "expiring"))
    target.run(_log_files(s, d))
    target.sweep(NOW_MS - 1)
    return ttl.live_at(target.entries(), NOW_MS)

"""Sorted runs: flush, tiers, compaction with a precedence rule, tiered reads.

Runs are rows (run_id, key, seq, ...), one per key and run. ``newest`` chooses the rule for
duplicates; the reading of the code where the oldest wins is the same path with ``newest=False``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.ordinal import whole_div, with_ordinal
from siltstone.operators.state import latest

FAN_IN = 4


def flush(log: DataFrame, ops_per_run: int, keep: tuple[str, ...] = ("value",)) -> DataFrame:
    """Cut a log into runs of ``ops_per_run`` mutations; within a run the last entry of a key counts."""
    cut = with_ordinal(log, "seq").withColumn("run_id", whole_div("ordinal", ops_per_run))
    return latest(cut, "run_id", keep=keep)


def run_summary(runs: DataFrame) -> DataFrame:
    """Per run: entries, least and greatest key, last sequence."""
    return runs.groupBy("run_id").agg(F.count("*").alias("n_entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("seq").alias("max_seq"))


def merge(runs: DataFrame, *group: str, newest: bool = True, keep: tuple[str, ...] = ("seq", "value")) -> DataFrame:
    """Merge runs into one per ``group``: a key's row of the newest (or oldest) run wins.

    A partially aggregated maximum in place of a heap over run streams: no sort, no window,
    and a hot key shrinks before the shuffle.
    """
    pick = F.max if newest else F.min
    return runs.groupBy(*group, "key").agg(pick(F.struct("run_id", *keep)).alias("w")).select(*group, "key", "w.*")


def merge_tiers(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Merge each ``fan_in`` consecutive runs newest-first and drop tombstones where that is safe.

    A tombstone must stay if an older run outside its group still holds the key, since
    dropping it would bring the old value back.
    """
    grouped = runs.withColumn("grp", whole_div("run_id", fan_in))
    merged = merge(grouped, "grp", keep=("seq", "op", "value"))
    oldest = merged.withColumn("__first", F.min("grp").over(Window.partitionBy("key")))
    return oldest.where(~((F.col("op") == "DELETE") & (F.col("__first") == F.col("grp")))).drop("__first")


def level_of(run_id: str, n: int | Column, fan_in: int = FAN_IN) -> Column:
    """Level of a flushed run when all compactions of ``n`` flushes are done: the greatest l whose block of fan_in**l runs around it is complete."""
    level, lvl = F.lit(0), 1
    n = n if isinstance(n, Column) else F.lit(n)
    while fan_in**lvl < 2**40:
        size = fan_in**lvl
        level = F.when((whole_div(run_id, size) + 1) * F.lit(size) <= n, F.lit(lvl)).otherwise(level)
        lvl += 1
    return level


def merged_run(run_id: str, level: Column, fan_in: int = FAN_IN) -> Column:
    """Number of the merged run of a level that a flushed run lies in, by whole division."""
    out, lvl = F.col(run_id), 1
    while fan_in**lvl < 2**40:
        out = F.when(level >= lvl, whole_div(run_id, fan_in**lvl)).otherwise(out)
        lvl += 1
    return out


def tiers(run_ids: DataFrame, n: int, fan_in: int = FAN_IN) -> DataFrame:
    """Level and merged run of each flushed run when all compactions of ``n`` flushes are done."""
    return run_ids.withColumn("level", level_of("run_id", n, fan_in)).withColumn("merged_run", merged_run("run_id", F.col("level"), fan_in))


def compact_tiers(runs: DataFrame, n: int, newest: bool = True, fan_in: int = FAN_IN, keep: tuple[str, ...] = ("seq", "value")) -> DataFrame:
    """The merged runs of all levels when all compactions of ``n`` flushes are done: level, merged_run, key and the winner's row.

    A run is merged once, into the run it ends up in; the rounds between change no result, since merging is associative.
    """
    return merge(tiers(runs, n, fan_in), "level", "merged_run", newest=newest, keep=keep)


def occupancy(membership: DataFrame) -> DataFrame:
    """Merged runs per level."""
    return membership.groupBy("level").agg(F.countDistinct("merged_run").alias("n_runs"))


def tiered_get(runs: DataFrame, newest: bool = True) -> DataFrame:
    """Each key's row by tier precedence: buffer (level -1), then levels upwards, then runs of a level.

    ``runs`` has run_id, level, key, seq, value. Where it has ``op``, too, a key whose first row in that order is a
    tombstone (DELETE) is gone and gives no row, whatever older runs hold.
    """
    ops = ["op"] * ("op" in runs.columns)
    order = F.struct(F.col("level"), (-F.col("run_id") if newest else F.col("run_id")).alias("r"), F.col("seq"), *ops, F.col("value"), F.col("run_id"))
    best = runs.groupBy("key").agg(F.min(order).alias("w"))
    if ops:
        best = best.where(~F.coalesce(F.col("w.op") == "DELETE", F.lit(False)))
    return best.select("key", "w.level", "w.run_id", "w.seq", "w.value")


def flush_when_full(log: DataFrame, keys: int, by: str, keep: tuple[str, ...] = ("value",)) -> DataFrame:
    """Cut each log of ``by`` into runs as a write buffer does that is flushed, and emptied, when it holds ``keys`` different keys.

    Gives ``by``, run_id from 0, key, seq and ``keep`` of the last entry of a key in a run; what is still in the buffer is the last run.
    Where a run ends depends on where the one before ended, so a log is taken in order; nothing is held but the buffer's
    keys. Logs of different ``by`` are independent. Rows with a null key or seq are no mutations.
    """
    src = log.where(F.col("key").isNotNull() & F.col("seq").isNotNull()).select(by, "seq", "key", *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema) + ", run_id long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, held, run = None, set(), 0
        for b in batches:
            numbers = []
            for o, k in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if o != owner:
                    owner, held, run = o, set(), 0
                numbers.append(run)
                held.add(k)
                if len(held) >= keys:
                    held, run = set(), run + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64())], names=[*b.schema.names, "run_id"])

    ordered = src.repartition(by).sortWithinPartitions(by, "seq")
    return latest(ordered.mapInArrow(cut, schema), by, "run_id", keep=keep)


def as_coded_deletes(log: DataFrame, ops_per_run: int) -> DataFrame:
    """Live keys if a delete counts only while its key is in the write buffer.

    Deletes of keys without an earlier put in the same buffer span are lost.
    """
    plain = log.where(F.col("op").isin("PUT", "DELETE"))
    cut = with_ordinal(plain, "seq").withColumn("run_id", whole_div("ordinal", ops_per_run))
    first = F.min(F.when(F.col("op") == "PUT", F.col("seq"))).over(Window.partitionBy("key", "run_id"))
    kept = cut.withColumn("__first", first).where((F.col("op") == "PUT") | (F.col("__first") < F.col("seq")))
    return latest(kept).where(F.col("op") == "PUT").select("key", "value")

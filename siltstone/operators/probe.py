"""Run filters and sparse indexes: build, probe and floor lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.hashing import FILTER_BITS, with_bits

# Bytes between index entries; of the length prefix, the timestamp field, and the number of a text field
INDEX_INTERVAL = 4096
PREFIX_BYTES, TIMESTAMP_BYTES, FIELD_BYTES = 4, 7, 1


def _hashed(df: DataFrame, bits: int) -> DataFrame:
    """Rows with their key's filter bits in ``bits``; rows that were written with them are taken as they are."""
    return df if "bits" in df.columns and bits == FILTER_BITS else with_bits(df, bits)


def filter_bits(runs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Set bits of each run's filter: (run_id, bit), once each. Runs may hold ``bits`` of their keys already."""
    rows = _hashed(runs.where(F.col("key").isNotNull()), bits)
    return rows.select("run_id", F.explode("bits").alias("bit")).select("run_id", F.col("bit").cast("long").alias("bit")).distinct()


def filters(runs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Each run's filter as one row of fixed size: run_id and ``words``, an array of 64 bits each, found by index."""
    rows = _hashed(runs.where(F.col("key").isNotNull()), bits).select("run_id", F.explode("bits").alias("bit"))
    masks = rows.groupBy("run_id", F.expr("bit div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("mask"))
    held = masks.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit((bits - 1) // 64)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    return held.select("run_id", dense.alias("words"))


def probe_filters(probes: DataFrame, run_filters: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """For probes (run_id, key): whether the run may hold the key (all three bits are set).

    One join on run_id against one row per run; a bit is found by index. A null key is never there; a run without a filter holds nothing.
    ``probes`` may hold ``bits`` of their keys already.
    """
    keep = ["run_id", "key", *["bits"] * ("bits" in probes.columns)]
    asked = _hashed(probes.select(*keep).distinct(), bits)  # a key's bits follow from it

    def is_set(i: int):
        bit = F.col("bits")[i]
        return F.bit_get(F.col("words")[F.expr(f"bits[{i}] div 64").cast("int")], bit % 64) == 1

    joined = asked.join(run_filters, "run_id", "left")
    return joined.select("run_id", "key", F.coalesce(is_set(0) & is_set(1) & is_set(2), F.lit(False)).alias("may_contain"))


def _varint(n):
    """Bytes of a length written seven bits a byte."""
    size = F.lit(5)
    for k in (4, 3, 2, 1):
        size = F.when(n < 1 << 7 * k, k).otherwise(size)
    return size


def record_bytes(key: str = "key", value: str = "value"):
    """Encoded length of a run record: a fixed prefix and time, then each text with its field number and length; an empty or null value takes no field."""

    def field(c: str):
        n = F.coalesce(F.octet_length(c), F.lit(0))
        return F.when(n > 0, n + FIELD_BYTES + _varint(n)).otherwise(0)

    return (F.lit(PREFIX_BYTES + TIMESTAMP_BYTES) + field(key) + field(value)).cast("long")


def sparse_index(runs: DataFrame, interval: int = INDEX_INTERVAL) -> DataFrame:
    """(run_id, key, offset) for the first record after every ``interval`` bytes of a run in key order.

    The count starts anew at each entry, so a run is taken in order: as a stream of sorted batches of which nothing is held but the run's
    last offset and entry. An entry is found by searching in the summed lengths, not row by row. A run of any size takes the same memory.
    """
    rec = runs.where(F.col("key").isNotNull()).select("run_id", "key", record_bytes().alias("len"))
    run_type = rec.schema["run_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at, since = None, 0, 0  # the run, the offset after its last record, and that of its last entry
        for b in batches:
            ids, size = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            hits, offsets = [], []
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if ids[lo] != run:
                    run, at, since = ids[lo], 0, 0
                begin = at + np.r_[0, np.cumsum(size[lo:hi])]  # where each record begins, and the end
                i = 0
                while (i := int(np.searchsorted(begin[:-1], since + interval, side="right"))) < hi - lo:
                    hits.append(lo + i)
                    since = int(begin[i])
                    offsets.append(since)
                at = int(begin[-1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hits, pa.int64())), b.column(1).take(pa.array(hits, pa.int64())), pa.array(offsets, pa.int64())], names=["run_id", "key", "offset"])

    ordered = rec.repartition("run_id").sortWithinPartitions("run_id", "key")
    return ordered.mapInArrow(fold, f"run_id {run_type}, key string, offset long")


def index_floor(probes: DataFrame, index: DataFrame) -> DataFrame:
    """Offset of the greatest index key <= the probe key in the same run; 0 before the first.

    An as-of lookup by one sort per run (union, then last value carried forward), not a range join.
    """
    p = probes.select("run_id", "key").distinct().select("run_id", "key", F.lit(None).cast("long").alias("offset"), F.lit(1).alias("side"))
    i = index.select("run_id", "key", "offset", F.lit(0).alias("side"))
    w = Window.partitionBy("run_id").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(i).withColumn("floor", F.last("offset", ignorenulls=True).over(w))
    return both.where(F.col("side") == 1).select("run_id", "key", F.coalesce("floor", F.lit(0)).alias("offset"))


def point_reads(probes: DataFrame, runs: DataFrame, run_filters: DataFrame, index: DataFrame) -> DataFrame:
    """Reads of single runs: filter, index floor, value. Only probes that pass the filter go on to the index and the run.

    Gives run_id, key, may_contain, offset (where the scan starts) and value (null if absent).
    """
    asked = probe_filters(probes, run_filters)
    floors = index_floor(asked.where("may_contain"), index)
    found = floors.join(runs.select("run_id", "key", "value"), ["run_id", "key"], "left").withColumn("may_contain", F.lit(True))
    kept = ["run_id", "key", "may_contain", "offset", "value"]
    return found.select(*kept).unionByName(asked.where("not may_contain"), allowMissingColumns=True)

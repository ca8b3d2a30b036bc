"""Least-recently-used caches: replay of gets, puts and deletes, and simulation over a log of accesses."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.ordinal import whole_div, with_ordinal


def final_content(log: DataFrame, capacity: int) -> DataFrame:
    """Keys cached in the end: those with the latest ``capacity`` last accesses (a top-k)."""
    last = log.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("seq").alias("last_seq"))
    return last.orderBy(F.desc("last_seq"), "key").limit(capacity)


#: Rows of block summaries that one task may fold.
SUMMARY_ROWS = 4_000_000


def hits(log: DataFrame, capacity: int, block: int = 1_000_000) -> DataFrame:
    """One row with accesses and hits when every access inserts or promotes its key.

    The log is cut into blocks of ``block`` accesses, or more where the summaries of all blocks
    would exceed SUMMARY_ROWS. The cache at a block's start is the last
    ``capacity`` distinct keys before it, folded from each block's own last ``capacity`` keys;
    the blocks are then replayed in parallel. Every access counts, and a cache holds at most
    ``capacity`` keys. An empty log gives zeros; rows with a null key are no accesses.
    """
    accesses = log.where(F.col("key").isNotNull()).select("seq", "key")
    block = max(block, -(-accesses.count() * capacity // SUMMARY_ROWS))
    acc = with_ordinal(accesses, "seq").withColumn("blk", whole_div("ordinal", block))
    last = acc.groupBy("blk", "key").agg(F.max("ordinal").alias("at"))
    top = last.withColumn("rk", F.row_number().over(Window.partitionBy("blk").orderBy(F.desc("at")))).where(F.col("rk") <= capacity).drop("rk")

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        """Cache content at the start of each block, from the blocks' last keys in order."""
        cache: OrderedDict[str, None] = OrderedDict()
        rows = []
        for blk, part in pdf.sort_values(["blk", "at"]).groupby("blk", sort=True):
            rows += [(blk, i, k) for i, k in enumerate(cache)]
            for k in part["key"]:
                cache.pop(k, None)
                cache[k] = None
            while len(cache) > capacity:
                cache.popitem(last=False)
        return pd.DataFrame(rows, columns=["blk", "ordinal", "key"])

    # a block gives at most ``capacity`` rows, and the blocks together at most SUMMARY_ROWS
    start = top.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda pdf: starts(pdf[["blk", "key", "at"]]), "blk long, ordinal long, key string")
    feed = acc.select("blk", "ordinal", "key", F.lit(1).alias("real")).unionByName(start.withColumn("ordinal", F.col("ordinal") - capacity * 2 - 1 - F.lit(2**40)).withColumn("real", F.lit(0)))

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blk, cache, n, hit = None, OrderedDict(), 0, 0
        for pdf in batches:
            for b, k, real in zip(pdf["blk"], pdf["key"], pdf["real"]):
                if b != blk:
                    blk, cache = b, OrderedDict()
                found = k in cache
                if found:
                    cache.move_to_end(k)
                else:
                    cache[k] = None
                    if len(cache) > capacity:
                        cache.popitem(last=False)
                if real:
                    n += 1
                    hit += found
        yield pd.DataFrame({"accesses": [n], "hits": [hit]})

    parts = feed.repartition("blk").sortWithinPartitions("blk", "ordinal").mapInPandas(replay, "accesses long, hits long")
    return parts.agg(F.coalesce(F.sum("accesses"), F.lit(0)).alias("accesses"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def replay(ops: DataFrame, capacity: int, by: str) -> DataFrame:
    """Replay GET, PUT and DELETE on one cache per value of ``by``: by, gets, hits, evictions, size in the end.

    A get of a cached key makes it the latest; a get of any other key changes nothing. A put inserts or overwrites, makes its key
    the latest and drops the oldest key beyond ``capacity``. A delete frees its key's place. ``ops`` has by, seq, op, key; other ops and rows
    with a null key are left out. What a get does depends on all before it, so a cache is taken in order; nothing is held but its
    keys, at most ``capacity``. Caches are independent of each other. No rows give no caches.
    """
    src = ops.where(F.col("op").isin("GET", "PUT", "DELETE") & F.col("key").isNotNull()).select(by, "seq", "op", "key")
    kind = src.schema[by].dataType.simpleString()
    none = object()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, kept, counts = none, OrderedDict(), [0, 0, 0]

        def row(types: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([owner], types), *(pa.array([n], pa.int64()) for n in (*counts, len(kept)))], names=[by, "gets", "hits", "evictions", "size"])

        owners = None
        for b in batches:
            owners = b.column(0).type
            for o, op, k in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                if o != owner:
                    if owner is not none:
                        yield row(owners)
                    owner, kept, counts = o, OrderedDict(), [0, 0, 0]
                if op == "GET":
                    counts[0] += 1
                    if k in kept:
                        counts[1] += 1
                        kept.move_to_end(k)
                elif op == "DELETE":
                    kept.pop(k, None)
                else:
                    kept[k] = None
                    kept.move_to_end(k)
                    if len(kept) > capacity:
                        kept.popitem(last=False)
                        counts[2] += 1
        if owner is not none:
            yield row(owners)

    ordered = src.repartition(by).sortWithinPartitions(by, "seq")
    return ordered.mapInArrow(run, f"`{by}` {kind}, gets long, hits long, evictions long, size long")

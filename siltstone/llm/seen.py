"""Has this key been seen before? Immutable fingerprint filters over sealed generations.

Runs are taken in generations of consecutive run ids. Within a cell of keys the generations
pass in order: each record is probed against the filters of all sealed generations, keys of
the current generation are handled exactly, and then the generation is sealed into a filter
of about 20 bits a key, built by peeling. Filters are written, so that later batches read them in place of
earlier keys, which are not kept.

A filter has no false negatives. It answers yes for an unseen key with probability 2**-16, so
with g sealed generations the answer is wrong at a rate of 1 - (1 - 2**-16)**g. ``verify`` then
removes the wrong ones among the flagged records.

Defined results: rows with a null store, run or key are no records and no occurrences. Repeated
rows are one record. Empty and very long keys are keys like any other. Ties within a run are no
earlier occurrence: only a smaller run id is. No rows give no records. Further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.functions.ordinal import whole_div
from siltstone.session import list_names, publish, published

RECORD = ("store_id", "run_id", "key")
FINGERPRINT_BITS = 16
#: Least width of a generation in runs, and how many generations there may be at most.
GENERATION_RUNS, GENERATIONS = 64, 32
#: Occurrences aimed at per cell; bounds the filters a worker holds. How many times the first batch may grow before cells hold more.
SHARD_ROWS, GROWTH = 2_000_000, 16

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    x = h.view(np.uint64) ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class PeeledFilter:
    """Static filter of 64-bit hashes: three slots a key whose XOR is the key's fingerprint."""

    def __init__(self, hashes: np.ndarray):
        keys = np.unique(hashes)
        self.block = max(4, int(len(keys) * 1.3 / 3) + 2)
        self.n = len(keys)
        for seed in range(1, 1000):
            self.seed = seed * 0x9E3779B97F4A7C15 % 2**64
            order = self._peel(keys)
            if order is not None:
                break
        else:
            raise RuntimeError("filter cannot be built")
        pos, mark = self._slots(keys)
        self.slots = np.zeros(3 * self.block, dtype=np.uint16)
        for k, at in reversed(order):
            p = pos[:, k]
            # the slot to fill is still zero, so it does not disturb the XOR
            self.slots[at] = mark[k] ^ self.slots[p[0]] ^ self.slots[p[1]] ^ self.slots[p[2]]

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = _mix(hashes, self.seed)
        b, low = np.uint64(self.block), np.uint64(0xFFFFFFFF)
        rot = [x, (x << np.uint64(21)) | (x >> np.uint64(43)), (x << np.uint64(42)) | (x >> np.uint64(22))]
        pos = np.stack([(((r & low) * b) >> np.uint64(32)).astype(np.int64) + i * self.block for i, r in enumerate(rot)])
        return pos, ((x * _M1) >> np.uint64(48)).astype(np.uint16)

    def _peel(self, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the slot each has alone); None if some keys never get a slot of their own."""
        pos, _ = self._slots(keys)
        size = 3 * self.block
        index = np.arange(len(keys), dtype=np.int64)
        count = np.bincount(pos.ravel(), minlength=size)
        total = np.zeros(size, dtype=np.int64)
        for row in pos:
            np.add.at(total, row, index)
        order, left = [], len(keys)
        alone = np.flatnonzero(count == 1)
        while len(alone):
            k, first = np.unique(total[alone], return_index=True)
            order.append((k, alone[first]))
            left -= len(k)
            p = pos[:, k]
            for row in p:
                np.subtract.at(count, row, 1)
                np.subtract.at(total, row, k)
            touched = np.unique(p.ravel())
            alone = touched[count[touched] == 1]
        return None if left else order

    def dump(self) -> bytes:
        return np.array([self.n, self.block, self.seed], dtype=np.uint64).tobytes() + self.slots.tobytes()

    @classmethod
    def load(cls, data: bytes) -> PeeledFilter:
        made = cls.__new__(cls)
        made.n, made.block, made.seed = np.frombuffer(data, np.uint64, 3).tolist()
        made.slots = np.frombuffer(data, np.uint16, offset=24)
        return made

    def __contains__(self, h: int) -> bool:
        return bool(self.probe(np.array([h], dtype=np.int64))[0])

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        p, mark = self._slots(hashes)
        return (self.slots[p[0]] ^ self.slots[p[1]] ^ self.slots[p[2]]) == mark


def occurrences(records: DataFrame, others: DataFrame | None, width: int) -> DataFrame:
    """(store_id, key, gen, min_run, runs): a key's occurrences in a generation, its records' runs in ``runs``.

    All records of a key in a generation get the same answer from the sealed filters, so they
    travel as one row of at most ``width`` run ids; a hot key is one row per generation.
    """
    rows = records.select(*RECORD, F.lit(True).alias("is_record"))
    if others is not None:
        rows = rows.unionByName(others.select(*RECORD, F.lit(False).alias("is_record")))
    rows = rows.na.drop(subset=list(RECORD)).withColumn("gen", whole_div("run_id", width))
    return rows.groupBy("store_id", "key", "gen").agg(F.min("run_id").alias("min_run"), F.collect_set(F.when(F.col("is_record"), F.col("run_id"))).alias("runs"))


class SeenKeys:
    """Sealed filters of all batches so far in a shared folder, for one writer: a new batch reads filters, never earlier keys.

    Keys are divided into cells by hash. A filter belongs to one cell and generation; a task takes its cells one by one, so it
    holds the filters of one cell at a time. The first call sets the number of cells, with room for ``GROWTH`` times its rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _filters(self, now: dict) -> DataFrame:
        sealed = [f"{self.path}/{b}/sealed=true" for b in now["batches"] if now["batches"][b]]
        return self.spark.read.schema("cell int, gen long, filter binary").parquet(*sealed) if sealed else self.spark.createDataFrame([], "cell int, gen long, filter binary")

    def apply(self, records: DataFrame, others: DataFrame | None = None) -> DataFrame:
        """Probe a batch of records, seal its generations, and return the answers.

        Batches must come in the order of their runs: a batch with a run that is not beyond all sealed ones raises ValueError, since a filter
        cannot tell which of its runs held a key. Within a batch runs may come in any order. A call that fails leaves the sealed filters as they were.
        """
        now = published(self.spark, self.path)
        both = records.select("run_id") if others is None else records.select("run_id").union(others.select("run_id"))
        low, high, n = both.agg(F.min("run_id"), F.max("run_id"), F.count("*")).first()
        if now is None:
            span = 0 if low is None else high - low + 1
            cells = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n * GROWTH // SHARD_ROWS) if n > SHARD_ROWS else 0)
            now = {"cells": cells, "width": max(GENERATION_RUNS, -(-span // GENERATIONS)), "last": None, "batches": {}}
        elif low is not None and now["last"] is not None and low <= now["last"]:
            raise ValueError(f"run {low} is not beyond the sealed run {now['last']}")
        batch = f"batch-{len(now['batches']):06d}-{uuid.uuid4().hex[:12]}"
        occ = occurrences(records, others, now["width"])
        self._probe(occ, now).write.partitionBy("sealed").parquet(f"{self.path}/{batch}")
        any_ = "sealed=true" in list_names(self.spark, f"{self.path}/{batch}")
        last = max([x for x in (now["last"], high) if x is not None], default=None)
        publish(self.spark, self.path, batch, cells=now["cells"], width=now["width"], last=last, batches={**now["batches"], batch: any_})
        return self._answers(batch if any_ else None)

    def _answers(self, batch: str | None) -> DataFrame:
        schema = "store_id int, key string, gen long, min_run long, runs array<long>, seen boolean, filters int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{batch}/sealed=false") if batch else self.spark.createDataFrame([], schema)

    def _probe(self, occ: DataFrame, now: dict) -> DataFrame:
        """Answers (sealed false) and the filters of the batch's own generations (sealed true), in one pass over each cell."""
        cells = now["cells"]
        hashed = occ.withColumn("hash", F.xxhash64("store_id", "key")).withColumn("cell", F.pmod(F.shiftrightunsigned("hash", 8), F.lit(cells)).cast("int")).withColumn("rank", F.lit(1))
        rows = hashed.unionByName(self._filters(now).withColumn("rank", F.lit(0)), allowMissingColumns=True)
        columns = ["cell", "rank", "gen", "filter", "hash", "store_id", "key", "min_run", "runs"]
        # earlier filters come first in their cell, then the batch's generations in order
        src = rows.select(*columns).repartitionById(cells, "cell").sortWithinPartitions("cell", "rank", "gen")
        kinds = {f.name: f.dataType for f in src.schema}
        out = ["store_id", "key", "gen", "min_run", "runs", "seen", "filters", "cell", "filter", "sealed"]
        schema = ", ".join(f"{c} {kinds[c].simpleString()}" for c in out[:5]) + ", seen boolean, filters int, cell int, filter binary, sealed boolean"
        arrow = [to_arrow_type(kinds[c]) for c in out[:5]] + [pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]

        def batch_of(**given: pa.Array) -> pa.RecordBatch:
            n = len(next(iter(given.values())))
            return pa.RecordBatch.from_arrays([given[c].cast(t) if c in given else pa.nulls(n, t) for c, t in zip(out, arrow)], names=out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sealed: list[PeeledFilter] = []
            current: list[np.ndarray] = []
            cell, gen = None, None

            def seal() -> Iterator[pa.RecordBatch]:
                if current:
                    made = PeeledFilter(np.concatenate(current))
                    sealed.append(made)
                    current.clear()
                    yield batch_of(cell=pa.array([cell]), gen=pa.array([gen]), filter=pa.array([made.dump()]), sealed=pa.array([True]))

            for b in batches:
                at = {c: b.column(i) for i, c in enumerate(columns)}
                place = np.stack([at[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "rank", "gen")])
                hashes = at["hash"].fill_null(0).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
                for lo, hi in zip(cuts, cuts[1:]):
                    if lo == hi:
                        continue
                    c, rank, g = place[:, lo].tolist()
                    if c != cell:
                        yield from seal()
                        sealed, cell, gen = [], c, None
                    if rank == 0:
                        sealed += [PeeledFilter.load(x) for x in at["filter"].slice(lo, hi - lo).to_pylist()]
                        continue
                    if g != gen:
                        yield from seal()
                        gen = g
                    part = hashes[lo:hi]
                    seen = np.zeros(hi - lo, dtype=bool)
                    for f in sealed:
                        seen |= f.probe(part)
                    current.append(part)
                    kept = {k: at[k].slice(lo, hi - lo) for k in out[:5]}
                    yield batch_of(**kept, seen=pa.array(seen), filters=pa.array(np.full(hi - lo, len(sealed), dtype=np.int32)), sealed=pa.array(np.zeros(hi - lo, dtype=bool)))
            yield from seal()

        return src.mapInArrow(run, schema)


def probed(records: DataFrame, others: DataFrame | None, path: str) -> DataFrame:
    """Answers of one batch, the first of the table of sealed filters in ``path``."""
    return SeenKeys(records.sparkSession, path).apply(records, others)


def verify(answers: DataFrame) -> DataFrame:
    """Flagged occurrences with ``right``: whether an earlier generation really holds the key.

    One exchange and no join: a key's rows, one per generation, meet in an aggregate, of which unflagged ones leave only their generation.
    """
    rest = [c for c in answers.columns if c not in ("store_id", "key")]
    held = answers.groupBy("store_id", "key").agg(F.min("gen").alias("first_gen"), F.collect_list(F.when(F.col("seen"), F.struct(*rest))).alias("flagged"))
    each = held.select("store_id", "key", "first_gen", F.explode("flagged").alias("f")).select("store_id", "key", "first_gen", "f.*")
    return each.withColumn("right", F.col("first_gen") < F.col("gen")).drop("first_gen")


def seen_records(answers: DataFrame) -> DataFrame:
    """Records whose key occurs under a smaller run id: store_id, run_id, key."""
    within = F.filter("runs", lambda r: r > F.col("min_run"))
    new = answers.where("not seen").select("store_id", "key", F.explode(within).alias("run_id"))
    old = verify(answers).select("store_id", "key", F.explode(F.when(F.col("right"), F.col("runs")).otherwise(within)).alias("run_id"))
    return new.unionByName(old).select(*RECORD)


def error_report(answers: DataFrame) -> DataFrame:
    """Per number of filters asked: probes of unseen keys, wrong answers, their rate, and the stated rate."""
    checked = verify(answers).groupBy("filters").agg(F.count_if("right").alias("right"), F.count_if(~F.col("right")).alias("wrong"))
    asked = answers.groupBy("filters").agg(F.count("*").alias("probes"))
    unseen = F.col("probes") - F.coalesce(F.col("right"), F.lit(0))
    wrong = F.coalesce(F.col("wrong"), F.lit(0))
    stated = 1 - F.pow(F.lit(1 - 2.0**-FINGERPRINT_BITS), F.col("filters"))
    return asked.join(checked, "filters", "left").select(
        "filters", "probes", unseen.alias("unseen"), wrong.alias("wrong"), F.try_divide(wrong, unseen).alias("measured_rate"), stated.alias("stated_rate")
    )

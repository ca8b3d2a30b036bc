"""Most frequent values within bounded memory: a heavy part with votes, a light part of counters.

Each split keeps buckets of a few exact counters. A value that is not in its full bucket votes
against the bucket; when the votes outweigh the smallest counter eight to one, that counter is
evicted and the newcomer takes its place. Evicted and rejected counts fall into one array of
counters addressed by hash. Splits are merged bucket by bucket: counters of the same value add
up, the greatest stay, the rest fall into the light array, and light arrays add up.

A heavy counter never exceeds the true count; counter plus light cell never falls below it.
So every value whose count could be among the greatest lies in a light cell or heavy counter
that shows it, and one more pass counts just the values of those cells exactly.

Defined results: null keys count nowhere; the empty string is a value. Ties at the end of the
list go to the lesser key. No rows give no values. Fewer distinct values than asked for give
all of them. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, SLOTS, CELLS = 2048, 8, 65_536
EVICT = 8
#: Ranges of the sketch that are merged apart from each other.
BLOCKS = 16
#: Splits whose sketches are merged by one task; the merged ones are merged in turn.
FAN_IN = 256


class HeavyLight:
    """The sketch of one split; all arrays have fixed sizes."""

    def __init__(self, buckets: int = BUCKETS, slots: int = SLOTS, cells: int = CELLS):
        self.value = np.zeros((buckets, slots), dtype=np.int64)
        self.votes = np.zeros((buckets, slots), dtype=np.int64)
        self.against = np.zeros(buckets, dtype=np.int64)
        #: counters that may have a part of their value's count in the light array
        self.partial = np.zeros((buckets, slots), dtype=bool)
        self.light = np.zeros(cells, dtype=np.int64)

    def cell(self, h: np.ndarray) -> np.ndarray:
        return ((h.view(np.uint64) >> np.uint64(32)) & np.uint64(len(self.light) - 1)).astype(np.int64)

    def add(self, hashes: np.ndarray, weights: np.ndarray) -> None:
        """Add distinct hashes with their counts, one per bucket at a time."""
        bucket = (hashes & (len(self.against) - 1)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        turn = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)]))
        by_turn = np.argsort(turn, kind="stable")
        for part in np.split(order[by_turn], np.flatnonzero(np.diff(turn[by_turn])) + 1):
            self._step(bucket[part], hashes[part], weights[part])

    def _step(self, b: np.ndarray, h: np.ndarray, w: np.ndarray) -> None:
        votes = self.votes[b]
        same = (self.value[b] == h[:, None]) & (votes > 0)
        known = same.any(1)
        self.votes[b[known], same[known].argmax(1)] += w[known]
        b, h, w, votes = b[~known], h[~known], w[~known], votes[~known]
        free = votes == 0
        open_ = free.any(1)
        at = free[open_].argmax(1)
        self.value[b[open_], at], self.votes[b[open_], at] = h[open_], w[open_]
        # a bucket with a free slot never refused a value, so the count is whole
        self.partial[b[open_], at] = False
        b, h, w, votes = b[~open_], h[~open_], w[~open_], votes[~open_]
        least = votes.argmin(1)
        self.against[b] += w
        out = self.against[b] >= EVICT * votes[np.arange(len(b)), least]
        eb, el = b[out], least[out]
        np.add.at(self.light, self.cell(self.value[eb, el]), self.votes[eb, el])
        self.value[eb, el], self.votes[eb, el], self.partial[eb, el] = h[out], w[out], True
        self.against[eb] = 0
        np.add.at(self.light, self.cell(h[~out]), w[~out])

    def merge(self, value: np.ndarray, votes: np.ndarray, partial: np.ndarray, against: np.ndarray, light: np.ndarray, first: int = 0) -> None:
        """Recombine buckets with those of another sketch, from bucket ``first`` on; ``light`` covers all cells or none."""
        n, s = value.shape
        rows = slice(first, first + n)
        v = np.concatenate([self.value[rows], value], 1)
        c = np.concatenate([self.votes[rows], votes], 1)
        p = np.concatenate([self.partial[rows], partial], 1)
        same = (v[:, :s, None] == v[:, None, s:]) & (c[:, :s, None] > 0) & (c[:, None, s:] > 0)
        i, j, k = np.nonzero(same)
        c[i, j] += c[i, s + k]
        p[i, j] |= p[i, s + k]
        c[i, s + k] = 0
        # a value that one side lacks may lie in that side's light part, if its bucket was full
        full_a, full_b = (c_side.all(1) for c_side in (self.votes[rows] > 0, votes > 0))
        p[:, :s] |= ~same.any(2) & full_b[:, None]
        p[:, s:] |= full_a[:, None]
        order = np.argsort(-c, axis=1, kind="stable")
        v, c, p = (np.take_along_axis(x, order, 1) for x in (v, c, p))
        lost, lost_n = v[:, s:].ravel(), c[:, s:].ravel()
        np.add.at(self.light, self.cell(lost[lost_n > 0]), lost_n[lost_n > 0])
        self.value[rows], self.votes[rows], self.partial[rows] = v[:, :s], c[:, :s], p[:, :s]
        self.against[rows] += against
        if len(light):
            self.light += light


def _sketches(keys: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Blocks of merged sketches: (block, value, votes, partial, against, light) as packed arrays."""
    hashed = keys.select(F.xxhash64("key").alias("h"))
    schema = "block int, part int, value binary, votes binary, partial binary, against binary, light binary"
    _, slots, all_cells = shape
    per, cells = shape[0] // BLOCKS, all_cells // BLOCKS

    names = ["block", "part", "value", "votes", "partial", "against", "light"]

    def pack(s: HeavyLight, blocks: range, split: int) -> pa.RecordBatch:
        parts = [
            (k, s.value[lo:hi].tobytes(), s.votes[lo:hi].tobytes(), s.partial[lo:hi].tobytes(), s.against[lo:hi].tobytes(), s.light[k * cells : (k + 1) * cells].tobytes())
            for k in blocks
            for lo, hi in [(k * per, (k + 1) * per)]
        ]
        cols = list(zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([split] * len(parts), pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, any_ = HeavyLight(*shape), False
        for b in batches:
            if b.num_rows:
                any_ = True
                s.add(*np.unique(b.column(0).to_numpy(), return_counts=True))
        if any_:
            yield pack(s, range(BLOCKS), TaskContext.get().partitionId() // FAN_IN)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge the sketches of one range and group; what falls out of its buckets goes to a light array of all cells."""
        done: dict[tuple[int, int], HeavyLight] = {}
        for b in batches:
            for block, group, value, votes, partial, against, light in zip(*(c.to_pylist() for c in b.columns)):
                s = done.get((block, group)) or done.setdefault((block, group), HeavyLight(*shape))
                part = (per, slots)
                s.merge(
                    np.frombuffer(value, np.int64).reshape(part), np.frombuffer(votes, np.int64).reshape(part), np.frombuffer(partial, bool).reshape(part),
                    np.frombuffer(against, np.int64), np.zeros(0, np.int64), first=block * per,
                )
                got = np.frombuffer(light, np.int64)
                # a split's sketch brings its range of the light cells, a merged one all of them
                cut = slice(block * cells, (block + 1) * cells) if len(got) < all_cells else slice(None)
                s.light[cut] += got
        for (block, group), s in done.items():
            lo, hi = block * per, (block + 1) * per
            arrays = (x.tobytes() for x in (s.value[lo:hi], s.votes[lo:hi], s.partial[lo:hi], s.against[lo:hi], s.light))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([group // FAN_IN], pa.int32()), *(pa.array([x], pa.binary()) for x in arrays)], names=names)

    # three rounds bring 256 ** 3 splits together; where there are few, all but the first are trivial
    first = hashed.mapInArrow(build, schema).repartition("block", "part").mapInArrow(join, schema)
    second = first.repartition("block", "part").mapInArrow(join, schema)
    return second.repartition(BLOCKS, "block").withColumn("part", F.lit(0)).mapInArrow(join, schema)


def sketch(keys: DataFrame, shape: tuple[int, int, int] = (BUCKETS, SLOTS, CELLS)) -> HeavyLight:
    """The sketch of all non-null ``key`` values; ``shape`` is (buckets, slots, cells), the first and
    last powers of two from BLOCKS on. At most BLOCKS rows of fixed size reach the driver."""
    whole = HeavyLight(*shape)
    per, slots = shape[0] // BLOCKS, shape[1]
    for r in _sketches(keys.select("key").where(F.col("key").isNotNull()), shape).collect():
        lo, hi = r.block * per, (r.block + 1) * per
        whole.value[lo:hi] = np.frombuffer(r.value, np.int64).reshape(per, slots)
        whole.votes[lo:hi] = np.frombuffer(r.votes, np.int64).reshape(per, slots)
        whole.partial[lo:hi] = np.frombuffer(r.partial, bool).reshape(per, slots)
        whole.against[lo:hi] = np.frombuffer(r.against, np.int64)
        whole.light += np.frombuffer(r.light, np.int64)
    return whole


def cell_of(key: Column, cells: int = CELLS) -> Column:
    """The light cell of a value, as the sketch computes it."""
    return F.shiftrightunsigned(F.xxhash64(key), 32).bitwiseAND(F.lit(cells - 1))


def most_frequent(df: DataFrame, k: int = 30, shape: tuple[int, int, int] = (BUCKETS, SLOTS, CELLS)) -> DataFrame:
    """The ``k`` most frequent keys: key, approx_n (the sketch's count), n (exact)."""
    spark = df.sparkSession
    s = sketch(df, shape)
    held = s.votes > 0
    h, low, part = s.value[held], s.votes[held], s.partial[held]
    cell = s.cell(h)
    estimate = low + np.where(part, s.light[cell], 0)
    # the k-th greatest lower bound: whatever cannot reach it is out
    least = np.sort(low)[-k] if len(low) >= k else 0
    ask = np.unique(np.r_[cell[estimate >= least], np.flatnonzero((s.light >= least) & (s.light > 0))])
    cells = spark.createDataFrame([(int(c),) for c in ask], "cell long")  # at most CELLS rows
    estimates = spark.createDataFrame([(int(a), int(b)) for a, b in zip(h, estimate)], "h long, approx_n long")  # at most BUCKETS * SLOTS rows
    rows = df.select("key").where(F.col("key").isNotNull())
    exact = rows.withColumn("cell", cell_of(F.col("key"), shape[2])).join(F.broadcast(cells), "cell", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    top = exact.orderBy(F.desc("n"), "key").limit(k)
    named = top.withColumn("h", F.xxhash64("key")).join(F.broadcast(estimates), "h", "left")
    # a value outside the heavy part has its light cell for an estimate
    light = spark.createDataFrame([(int(c), int(s.light[c])) for c in ask], "cell long, cell_n long")
    both = named.withColumn("cell", cell_of(F.col("key"), shape[2])).join(F.broadcast(light), "cell", "left")
    return both.select("key", F.coalesce("approx_n", "cell_n").alias("approx_n"), "n")

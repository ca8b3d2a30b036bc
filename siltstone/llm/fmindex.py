"""FM-index over word symbols: suffix sorting, wavelet matrix, backward search, sampled positions.

All operations are vectorised: a search takes all patterns one symbol further at a time.
"""

from __future__ import annotations

import io

import numpy as np

#: Every so many text positions the suffix position is kept.
SAMPLE = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of symbols below 2**31, by sorting as many symbols at once as 63 bits hold and then doubling.

    Each round sorts only suffixes that are not yet told apart.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    bits = (int(s.max()) + 1).bit_length()
    first = 63 // bits
    pad = np.zeros(n + first, dtype=np.int64)
    pad[:n] = s.astype(np.int64) + 1
    key = np.zeros(n, dtype=np.int64)
    for j in range(first):
        key = key << bits | pad[j : n + j]
    sa = np.argsort(key, kind="stable")
    k, width = key[sa], first
    new = np.r_[True, k[1:] != k[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = start
    open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))
    while len(open_):
        at = sa[open_]
        ahead = at + width
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[open_] = at
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        open_ = open_[~(new & np.r_[new[1:], True])]
        width *= 2
    return sa


class Bits:
    """Bit vector with constant-time rank."""

    __slots__ = ("words", "before", "n")

    def __init__(self, words: np.ndarray, n: int):
        self.words, self.n = words, n
        self.before = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    @classmethod
    def pack(cls, bits: np.ndarray) -> Bits:
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((len(bits) >> 6) + 1 << 3, dtype=np.uint8)
        padded[: len(packed)] = packed
        return cls(padded.view(np.uint64), len(bits))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """Index of one text of symbols."""

    def __init__(self, levels: list[Bits], counts: np.ndarray, marked: Bits, samples: np.ndarray, n: int):
        self.levels, self.counts, self.marked, self.samples, self.n = levels, counts, marked, samples, n
        self.zeros = [n - int(b.before[-1]) for b in levels]

    @classmethod
    def build(cls, s: np.ndarray, symbols: int) -> FMIndex:
        """Index of ``s`` followed by an end mark; symbols are 1 .. symbols - 1, the mark is 0."""
        text = np.r_[s.astype(np.uint32), np.uint32(0)]
        n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        depth = max(1, int(symbols - 1).bit_length())
        levels, cur = [], bwt
        for d in range(depth - 1, -1, -1):
            bit = (cur >> d & 1).astype(bool)
            levels.append(Bits.pack(bit))
            cur = np.r_[cur[~bit], cur[bit]]
        counts = np.zeros(symbols + 1, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=symbols), out=counts[1:])
        kept = sa % SAMPLE == 0
        return cls(levels, counts, Bits.pack(kept), sa[kept].astype(np.int32), n)

    def dump(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"l{i}": b.words for i, b in enumerate(self.levels)}
        np.savez(out, counts=self.counts.astype(np.int32), marked=self.marked.words, samples=self.samples, n=np.array([self.n]), **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> FMIndex:
        with np.load(io.BytesIO(data)) as z:
            n = int(z["n"][0])
            depth = sum(k.startswith("l") for k in z.files)
            return cls([Bits(z[f"l{i}"], n) for i in range(depth)], z["counts"].astype(np.int64), Bits(z["marked"], n), z["samples"], n)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c among the first i symbols of the transform."""
        lo = np.zeros_like(i)
        depth = len(self.levels)
        for d, (b, z) in enumerate(zip(self.levels, self.zeros)):
            one = (c >> (depth - 1 - d) & 1).astype(bool)
            r, rl = b.rank(i), b.rank(lo)
            i = np.where(one, z + r, i - r)
            lo = np.where(one, z + rl, lo - rl)
        return i - lo

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search by one symbol: rows of the patterns with c put in front."""
        r = self.rank(np.r_[c, c], np.r_[lo, hi])
        return self.counts[c] + r[: len(c)], self.counts[c] + r[len(c) :]

    def start(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.counts[c], self.counts[c + 1]

    def back(self, i: np.ndarray) -> np.ndarray:
        """Row of the suffix one position earlier."""
        c = np.zeros_like(i)
        at, lo = i, np.zeros_like(i)
        for b, z in zip(self.levels, self.zeros):
            one = b.get(at)
            r, rl = b.rank(at), b.rank(lo)
            c = c << 1 | one
            at = np.where(one, z + r, at - r)
            lo = np.where(one, z + rl, lo - rl)
        return self.counts[c] + at - lo

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to the next sampled position."""
        out = np.zeros(len(rows), dtype=np.int64)
        open_, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(open_):
            hit = self.marked.get(at)
            out[open_[hit]] = self.samples[self.marked.rank(at[hit])] + steps
            open_, at = open_[~hit], at[~hit]
            if len(open_):
                at = self.back(at)
            steps += 1
        return out

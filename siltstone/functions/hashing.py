"""The three key hashes of the run filters, as built-in column expressions and, for whole tables, as numpy steps over Arrow batches.

The expressions fold a key's bytes one by one in interpreted code, so ``with_bits`` takes one byte of all keys of a batch at a time instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
FILTER_BITS = 10_000
FNV_OFFSET = 0x811C9DC5
FNV_PRIME = 0x01000193
MIX_SEED = 0x9747B28C
MIX_MULTIPLIER = 0x5BD1E995

_MASK = 4294967295


def _signed(u: Column) -> Column:
    """A 32-bit pattern held in a long, read as a signed int; the operand is evaluated once."""
    return F.shiftright(F.shiftleft(u, 32), 32)


def _bytes(key: Column) -> Column:
    """The key's UTF-8 bytes as longs, sign-extended to 32 bits as signed bytes are."""
    # one character per byte
    chars = F.decode(F.encode(key, "UTF-8"), "ISO-8859-1")

    def extended(c: Column) -> Column:
        return F.shiftright(F.shiftleft(F.ascii(c).cast("long"), 56), 56).bitwiseAND(F.lit(_MASK))

    return F.when(F.length(chars) > 0, F.transform(F.split(chars, ""), extended)).when(F.length(chars) == 0, F.array().cast("array<bigint>"))


def sha_hash(key: Column) -> Column:
    """First four bytes of SHA-256, big-endian, signed. Null for a null key."""
    return _signed(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"))


def _fnv_step(h: Column, b: Column) -> Column:
    return h.bitwiseXOR(b).bitwiseAND(F.lit(_MASK)) * F.lit(FNV_PRIME) % F.lit(4294967296)


def _mix_step(h: Column, b: Column) -> Column:
    """A 32-bit value times the multiplier stays below 2**63."""
    t = (h.bitwiseXOR(b).bitwiseAND(F.lit(_MASK)) * F.lit(MIX_MULTIPLIER)).bitwiseAND(F.lit(_MASK))
    return t.bitwiseXOR(F.shiftright(t, 15))


def fnv_hash(key: Column) -> Column:
    """FNV-1a over signed bytes, 32 bits, signed. Null for a null key."""
    return _signed(F.aggregate(_bytes(key), F.lit(FNV_OFFSET).cast("long"), _fnv_step))


def mix_hash(key: Column) -> Column:
    """Multiply-and-shift hash over signed bytes, 32 bits, signed. Null for a null key."""
    return _signed(F.aggregate(_bytes(key), F.lit(MIX_SEED).cast("long"), _mix_step))


def bit_position(h: Column, bits: int = FILTER_BITS) -> Column:
    """Filter bit of a signed hash: absolute value of the truncated remainder."""
    return F.abs(h % F.lit(bits))


def bit_positions(key: Column, bits: int = FILTER_BITS) -> Column:
    """The three filter bits of a key as an array. Both byte-wise hashes are folded in one pass. Null for a null key."""
    start = F.struct(F.lit(MIX_SEED).cast("long").alias("m"), F.lit(FNV_OFFSET).cast("long").alias("f"))
    both = F.aggregate(
        _bytes(key),
        start,
        lambda h, b: F.struct(_mix_step(h["m"], b).alias("m"), _fnv_step(h["f"], b).alias("f")),
        lambda h: F.array(bit_position(_signed(h["m"]), bits), bit_position(_signed(h["f"]), bits)),
    )
    return F.concat(F.array(bit_position(sha_hash(key), bits)), both)


#: Bytes of a key from which it is hashed by itself, so that one long key does not slow a batch.
LONG_KEY = 512


def byte_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned 32-bit (mix, fnv) hashes of byte strings that lie in ``data``."""
    mix = np.full(len(starts), MIX_SEED, dtype=np.uint64)
    fnv = np.full(len(starts), FNV_OFFSET, dtype=np.uint64)
    # bytes sign-extended to 32 bits
    wide = data.view(np.int8).astype(np.int64).astype(np.uint64) & np.uint64(_MASK)

    def step(at: np.ndarray, j: int) -> None:
        b = wide[starts[at] + j]
        t = ((mix[at] ^ b) * np.uint64(MIX_MULTIPLIER)) & np.uint64(_MASK)
        mix[at] = t ^ (t >> np.uint64(15))
        fnv[at] = ((fnv[at] ^ b) * np.uint64(FNV_PRIME)) & np.uint64(_MASK)

    order = np.argsort(-lengths, kind="stable")  # keys that are still going on come first
    going = np.searchsorted(-lengths[order], -np.arange(min(int(lengths.max(initial=0)), LONG_KEY)), side="left")
    for j, n in enumerate(going.tolist()):
        step(order[:n], j)
    for i in order[: int(np.count_nonzero(lengths > LONG_KEY))].tolist():
        m, f = int(mix[i]), int(fnv[i])
        for b in wide[starts[i] + LONG_KEY : starts[i] + lengths[i]].tolist():
            m = ((m ^ b) * MIX_MULTIPLIER) & _MASK
            m ^= m >> 15
            f = ((f ^ b) * FNV_PRIME) & _MASK
        mix[i], fnv[i] = m, f
    return mix, fnv


def positions(keys: pa.Array, bits: int = FILTER_BITS) -> np.ndarray:
    """Three filter bits per key, as rows; those of null keys have no meaning."""
    keys = keys.cast(pa.large_binary())
    _, offsets, data = keys.buffers()
    at = np.frombuffer(offsets, np.int64)[keys.offset : keys.offset + len(keys) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    unsigned = byte_hashes(raw, at[:-1], np.diff(at))
    whole = memoryview(raw)
    sha = np.fromiter((int.from_bytes(hashlib.sha256(whole[a:b]).digest()[:4]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())), dtype=np.uint64, count=len(keys))
    signed = [h.astype(np.uint32).view(np.int32).astype(np.int64) for h in (sha, *unsigned)]
    return np.stack([np.abs(np.fmod(h, bits)) for h in signed], 1)


def with_bits(df: DataFrame, bits: int = FILTER_BITS, key: str = "key", name: str = "bits") -> DataFrame:
    """Add the key's three filter bits as an array of ints, null for a null key. A column called as ``name`` is replaced."""
    src = df.drop(name)
    at = src.columns.index(key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema) + f", `{name}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(at)
            flat = pa.array(positions(keys.fill_null(""), bits).astype(np.int32).ravel())
            places = pa.array(np.arange(0, 3 * len(keys) + 1, 3, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(places, flat, mask=keys.is_null())], names=[*b.schema.names, name])

    return src.mapInArrow(run, schema)

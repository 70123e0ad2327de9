"""Bloom filters of bounded size, made block by block on the executors.

A key is a 64-bit hash; its upper bits choose a block, and all its probes fall into that block, so a
block is filled by itself from its own keys. A key may be entered at several levels, each
with probes of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.words import mixed

PROBES = 3
#: Bits of one block; blocks are what the driver receives.
BLOCK = 1 << 19
#: Keys that are looked up at a time.
_RUN = 1 << 13
_STEP = 0xA0761D6478BD642F


def bits_for(keys: int, most: int, each: int = 12) -> int:
    """Whole blocks of ``each`` bits a key or more, but at most ``most`` bits (a multiple of ``BLOCK``)."""
    return min(most, max(1, -(-each * keys // BLOCK)) * BLOCK)


def _places(keys: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first probe of each key at its level, the step to the next one, and by how much each step is longer than the one before."""
    salt = (np.atleast_1d(level).astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP)
    h = mixed(mixed(keys + salt))
    return tuple((h >> np.uint64(n)).astype(np.uint32) | np.uint32(n == 7) for n in (45, 26, 7))


def entered(bits: int, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, probes: int = PROBES, higher: int | None = None) -> np.ndarray:
    """The filter of these keys (uint64) at levels ``lo`` to ``hi``, as ``contains`` reads it; for keys that one task holds."""
    levels = (hi - lo + 1).astype(np.int64)
    begin = np.cumsum(levels) - levels
    level = np.repeat(lo, levels) + np.arange(levels.sum()) - np.repeat(begin, levels)
    base = np.repeat((key >> np.uint64(8)) % np.uint64(bits // BLOCK) * np.uint64(BLOCK), levels)
    at, step, more = _places(np.repeat(key, levels), level)
    flags = np.zeros(bits, dtype=bool)
    for k in range(probes):
        if k == higher:
            lowest = np.zeros(len(at), dtype=bool)
            lowest[begin] = True
            base, at, step, more = base[lowest], at[lowest], step[lowest], more[lowest]
        flags[base + (at & np.uint32(BLOCK - 1))] = True
        at += step
        step += more
    return np.packbits(flags, bitorder="little")


def build(keys: DataFrame, bits: int, probes: int = PROBES, higher: int | None = None) -> np.ndarray:
    """The filter of all rows of ``key`` (bigint), ``lo`` and ``hi`` (levels, inclusive): ``bits`` / 8 bytes, whatever the number of keys.

    ``higher``: probes at levels above ``lo``, where fewer may do.
    """
    block = F.shiftrightunsigned("key", 8) % F.lit(bits // BLOCK)
    dealt = keys.filter("key IS NOT NULL AND lo <= hi").select(block.cast("bigint").alias("block"), "key", "lo", "hi")
    dealt = dealt.repartition("block").sortWithinPartitions("block")

    def filled(n: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, lo, hi = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([entered(BLOCK, key, lo, hi, probes, higher).tobytes()], pa.binary())], ["block", "bits"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for b in batches:
            block = b.column("block").to_numpy()
            cols = b.column("key").to_numpy().view(np.uint64), b.column("lo").to_numpy(), b.column("hi").to_numpy()
            cuts = np.flatnonzero(np.diff(block)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
                if lo == hi:
                    continue
                if block[lo] != now and held:
                    yield filled(now, held)
                    held = []
                now = int(block[lo])
                held.append(tuple(c[lo:hi] for c in cols))
        if held:
            yield filled(now, held)

    found = dealt.mapInArrow(fill, "block bigint, bits binary").toArrow()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for n, packed in zip(found.column("block").to_pylist(), found.column("bits")):
        out[n * BLOCK // 8 : (n + 1) * BLOCK // 8] = np.frombuffer(packed.as_buffer(), dtype=np.uint8)
    found = packed = None
    pa.default_memory_pool().release_unused()
    return out


def contains(bitmap: np.ndarray, keys: np.ndarray, level: int = 0, probes: int = PROBES) -> np.ndarray:
    """For each key (uint64): was it entered at ``level``? Wrong only as true."""
    if len(keys) > _RUN:
        return np.concatenate([contains(bitmap, keys[k : k + _RUN], level, probes) for k in range(0, len(keys), _RUN)])
    base = ((keys >> np.uint64(8)) % np.uint64(len(bitmap) * 8 // BLOCK)).astype(np.int64) * (BLOCK // 8)
    at, step, more = _places(keys, level)
    alive, hit = np.arange(len(keys)), np.ones(len(keys), dtype=bool)
    for k in range(probes):
        place = at & np.uint32(BLOCK - 1)
        hit &= (bitmap.take(base + (place >> np.uint32(3))) >> (place & np.uint32(7)).astype(np.uint8) & np.uint8(1)).view(bool)
        if np.count_nonzero(hit) * 8 < len(hit) * 7:  # few misses are carried along
            left = np.flatnonzero(hit)
            base, alive, at, step, more = (x.take(left) for x in (base, alive, at, step, more))
            hit = np.ones(len(alive), dtype=bool)
        at += step
        step += more
    found = np.zeros(len(keys), dtype=bool)
    found[alive] = hit
    return found

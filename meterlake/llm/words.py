"""Words of many texts at once, as 64-bit hashes in numpy arrays. Words are runs outside ASCII white space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that a task takes at a time.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, text_col: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``most`` bytes of text; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(text_col)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def hash_values(values: pa.Array) -> np.ndarray:
    """XXH64 of each string, computed once for each different one."""
    import xxhash

    coded = values.dictionary_encode()
    known = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return known[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else known


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, flat, and the offsets of each text's words (one more than texts)."""
    trimmed = pc.ascii_trim_whitespace(texts)
    lists = pc.ascii_split_whitespace(trimmed)
    words = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
    if blank.any():  # a blank text gives one empty word
        words = words.filter(pc.not_equal(words, ""))
        counts[blank] = 0
    return words, np.concatenate(([0], np.cumsum(counts)))


def mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))) * MIX


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring hashes."""
    m = len(hashes) - n + 1
    out = np.zeros(max(m, 0), dtype=np.uint64)
    if m > 0:
        for k in range(n):
            out = out * BASE + hashes[k : k + m]
    return mixed(out)


def same_text(offsets: np.ndarray, n: int) -> np.ndarray:
    """For each run of ``n`` neighbouring words of the flat array: is it inside one text?"""
    total = int(offsets[-1])
    inside = np.ones(max(total - n + 1, 0), dtype=bool)
    for e in offsets[1:-1]:
        inside[max(0, e - n + 1) : e] = False
    return inside

"""Near-duplicates by resemblance: min-hash bands, exact shingle check, connected components.

Two texts are linked if the Jaccard similarity of their sets of ``SHINGLE``-word shingles
is ``LIKE`` (a fraction, 4/5) or more. Candidates are, first, texts whose SimHash fingerprints differ in at most
3 bits, found by pigeonhole blocks as in ``simhash``. These are the closest copies only: at 0.8 a fingerprint of 64 bits
differs in up to some 11 bits, and blocks that survive 11 changes are too short to
tell texts apart. So candidates are also texts that agree on all ``ROWS`` min-hashes of one of
``BANDS`` bands: of pairs at exactly 0.8 this misses (1 - 0.8 ** 5) ** 24, one in 14,000, at 0.9 none in
10 ** 9. What meets, directly or not, is a group; inside a group all pairs are compared by their
whole sets, so no link rests on an estimate. Only sets of texts in groups are shuffled.

Texts of equal words are one node, so exact copies cost nothing. Inside a group only a
spanning forest of the links is emitted. A group of more than ``SLICE`` shingles is split into
slices, and each two slices are compared in a task of their own, so no group has to fit one
task and every link is still checked.

Words are runs outside ASCII white space, A-Z lower-cased, compared by 64-bit hashes, as
shingles are. A text of fewer words than a shingle is one shingle; texts of no words are equal.

Defined results: as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm import simhash
from meterlake.llm.bitmap import bits_for, build, contains
from meterlake.llm.components import components
from meterlake.llm.shared import materialize, text_of
from meterlake.llm.simhash import _with_last, kept, placed
from meterlake.llm.words import hash_values, mixed, rolling, slices, split_words

SHINGLE, LIKE = 5, (4, 5)
BANDS, ROWS = 24, 5
#: Shingles of one group that a task compares with each other.
SLICE = 1 << 20
#: Bits of the filter of nodes in groups; beyond them it passes more sets on, which costs time, not results.
FILTER_BITS = 1 << 28
_RNG = np.random.default_rng(64)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def shingled(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its node (hash of its words); and the hashes of all shingles, flat, with their offsets. Every text has one or more."""
    import xxhash

    words, at = split_words(pc.ascii_lower(texts))
    hashes = hash_values(words)
    node = np.fromiter((xxhash.xxh64_intdigest(hashes[a:b].tobytes()) for a, b in zip(at, at[1:])), dtype=np.uint64, count=len(texts))
    every, n = rolling(hashes, shingle), np.diff(at)
    counts = np.maximum(n - shingle + 1, 1)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    short = n < shingle
    flat = np.empty(offsets[-1], dtype=np.uint64)
    one = np.repeat(short, counts)
    flat[one] = node[short]
    if not one.all():
        within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts)
        flat[~one] = every[(np.repeat(at[:-1], counts) + within)[~one]]
    return node, flat, offsets


def bands(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each text."""
    small = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(out), band + 1, dtype=np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat((small ^ _XOR[k]) * _ODD[k], offsets[:-1])
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, band] = key
    return out


def prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id_col``, ``fp`` (the node), ``size`` (shingles, repeats included), ``keys`` (of the bands) and ``simhash`` (the fingerprint)."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                node, flat, offsets = shingled(part.column("text"), shingle)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * BANDS), pa.array(bands(flat, offsets).view(np.int64).ravel()))
                bits = np.array([simhash.fingerprint(t) for t in part.column("text").to_pylist()], dtype=np.uint64)
                cols = [part.column("id"), pa.array(node.view(np.int64)), pa.array(np.diff(offsets)), keys, pa.array(bits.view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "fp", "size", "keys", "simhash"])

    return rows.mapInArrow(run, f"id {kind}, fp bigint, size bigint, keys array<bigint>, simhash bigint").withColumnRenamed("id", id_col)


def sets(docs: DataFrame, nodes: np.ndarray, text_col: str, shingle: int) -> DataFrame:
    """``fp`` and ``items``, the different shingles, of texts whose node the filter ``nodes`` holds; a task gives each node once."""
    shared = docs.sparkSession.sparkContext.broadcast(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for part in slices(b):
                node, flat, offsets = shingled(part.column("text"), shingle)
                new = []
                for i in np.flatnonzero(contains(shared.value, node)).tolist():
                    if int(node[i]) not in seen:
                        seen.add(int(node[i]))
                        new.append(i)
                items = [np.unique(flat[offsets[i] : offsets[i + 1]]).view(np.int64) for i in new]
                yield pa.RecordBatch.from_arrays([pa.array(node[new].view(np.int64)), pa.array(items, pa.list_(pa.int64()))], ["fp", "items"])

    return docs.select(text_of(docs[text_col]).alias("text")).mapInArrow(run, "fp bigint, items array<bigint>")


def forest(items: list[np.ndarray], like: tuple[int, int] = LIKE) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the links among sets."""
    sizes = np.array([len(x) for x in items])
    codes = np.unique(np.concatenate(items), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    mine = lambda i: codes[ends[i] - sizes[i] : ends[i]]
    left, flat, edges = np.arange(len(items)), codes, []
    marked = np.zeros(codes.max() + 1, dtype=bool)

    def without(gone: np.ndarray) -> None:
        nonlocal left, flat
        flat = flat[np.repeat(~gone, sizes[left])]
        left = left[~gone]

    while len(left) > 1:
        todo = [int(left[0])]
        without(left == todo[0])
        while todo and len(left):
            x = todo.pop()
            marked[mine(x)] = True
            both = np.add.reduceat(marked[flat], np.cumsum(sizes[left]) - sizes[left], dtype=np.int64)
            marked[mine(x)] = False
            near = both * like[1] >= like[0] * (sizes[x] + sizes[left] - both)
            if near.any():
                found = left[near].tolist()
                without(near)
                edges += [(x, y) for y in found]
                todo += found
    return edges


def _forests(like: tuple[int, int]):
    """Forests of runs of rows with equal (root, i, j); rows come sorted by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for last, b in _with_last(batches):
            if held is not None:
                b = pa.concat_batches([held, b])
            cols = [b.column(n).to_numpy(zero_copy_only=False) for n in ("root", "i", "j")]
            new = np.zeros(b.num_rows, dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            bounds = [0, *np.flatnonzero(new).tolist(), b.num_rows]
            held = None
            if not last:
                held = b.slice(bounds[-2])
                bounds.pop()
            fps, edges = b.column("fp").to_numpy(), []
            for lo, hi in zip(bounds, bounds[1:]):
                different, first = np.unique(fps[lo:hi], return_index=True)
                if len(different) > 1:
                    items = [b.column("items")[lo + k].values.to_numpy() for k in first.tolist()]
                    edges += [(different[x], different[y]) for x, y in forest(items, like)]
            if edges:
                a = np.array(edges, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    return run


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) that connect ``nodes`` (``fp``, ``simhash``) whose fingerprints are equal or differ in few bits, as ``simhash.links`` finds them."""
    first = materialize(nodes.groupBy("simhash").agg(F.min("fp").alias("first"), F.max("fp").alias("last")), "fingerprints")
    equal = nodes.join(first.filter("first < last"), "simhash").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    near = simhash.links(first.select(F.col("simhash").alias("fp")))
    for c in ("a", "b"):
        near = near.join(first.select(F.col("simhash").alias(c), F.col("first").alias(f"{c}_fp")), c)
    return equal.union(near.select("a_fp", "b_fp"))


def links(docs: DataFrame, nodes: DataFrame, text_col: str, shingle: int, like: tuple[int, int], slice_items: int = SLICE) -> DataFrame:
    """Edges (``a``, ``b``) that connect the linked ones among ``nodes`` (``fp``, ``size``, ``keys``, ``simhash``), the distinct nodes of ``docs``."""
    keyed = nodes.select("fp", F.explode("keys").alias("v"))
    met = keyed.groupBy("v").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).filter("b < most").select("v", "b")
    groups = components(keyed.join(met, "v").select(F.col("fp").alias("a"), "b").union(by_fingerprint(nodes)))
    members = groups.select(F.col("node").alias("fp"), "root").union(groups.select(F.col("root").alias("fp"), "root").distinct())
    members = materialize(members.join(nodes.select("fp", "size"), "fp"), "groups")
    busy = members.groupBy("root").agg(F.ceil(F.sum("size") / slice_items).cast("int").alias("slices"))
    keys = members.select(F.col("fp").alias("key"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    held = sets(docs, build(keys, bits_for(members.count(), FILTER_BITS)), text_col, shingle)
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    tiles = held.join(members.join(busy, "root").select("fp", "root", "slices", own.alias("own")), "fp").select(
        "root", "fp", "items", "own", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other")
    )
    tiles = tiles.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "items")
    return tiles.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_forests(like), "a bigint, b bigint")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, like: tuple[int, int] = LIKE, slice_items: int = SLICE) -> DataFrame:
    """One row per document: id, ``fp`` and ``component_id``, the smallest id among the documents it is linked to, directly or not."""
    found = materialize(prints(docs, id_col, text_col, shingle), "bands")
    nodes = materialize(found.groupBy("fp").agg(F.min(id_col).alias("rep"), F.max("size").alias("size"), F.max("keys").alias("keys"), F.max("simhash").alias("simhash")), "nodes")
    return placed(found, nodes, links(docs, nodes, text_col, shingle, like, slice_items), id_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, like: tuple[int, int] = LIKE) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id, as in ``drop_near_duplicates``."""
    return kept(docs, near_copies(docs, id_col, text_col, shingle, like), id_col)

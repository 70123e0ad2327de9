"""Near-duplicates by SimHash: pigeonhole blocks, Hamming check, connected components.

A fingerprint has 64 bits; two texts are linked if theirs differ in at most 3. The bits
are split into 5 blocks. Three differing bits touch at most 3 blocks, so a linked pair
agrees on 2 of them: fingerprints meet under the 10 pairs of blocks, as keys of
about 26 bits. Equal fingerprints are one node before any of this, so exact copies
cost nothing. Inside a bucket only a spanning forest of the links is emitted, never
all pairs; a bucket of more than ``SLICE`` fingerprints is split into slices, and
each two slices are compared in a task of their own, so no bucket has to fit one task
and every link is still checked.

Words are runs outside ASCII white space, A-Z lower-cased; shingles are 3 words
joined by a blank, repeats included; a text of fewer words is one shingle, a text of none has fingerprint
zero. A bit is set if it is set in over half of the shingles' XXH64 (seed 42).

Defined results: null text is read as empty; repeated rows are linked like any equal
texts and each returned; a null id stays null and never names a component, so a
component of null ids alone has a null id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.components import components
from meterlake.llm.lookup import without
from meterlake.llm.shared import materialize, text_of
from meterlake.sources.tables import table

SHINGLE, SEED, MOST_BITS, BLOCKS = 3, 42, 3, 5
#: Fingerprints of one bucket that a task compares with each other.
SLICE = 4096
_CHUNK = 1 << 16


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of a text."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    digest, join = xxhash.xxh64_digest, b" ".join
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, _CHUNK):
        part = words[k : k + _CHUNK + SHINGLE - 1] if n > 1 else words
        shingles = map(join, zip(*(part[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [join(words)]
        raw = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed 64-bit integer."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                fps = np.array([fingerprint(t) for t in part.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps)], ["id", "fp"])

    return rows.mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def block_masks(blocks: int = BLOCKS, most: int = MOST_BITS) -> list[int]:
    """A mask for each choice of blocks that a linked pair may agree on, as signed 64-bit integers."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - most)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(fps: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints (uint64)."""
    left, edges = fps, []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= most
            if near.any():
                found = left[near]
                left = left[~near]
                edges += [(x, y) for y in found]
                todo += list(found)
    return edges


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of runs of rows with equal (k, v, i, j); rows come sorted by these."""
    keep = None
    for last, b in _with_last(batches):
        cols = [b.column(n).to_numpy(zero_copy_only=False) for n in ("k", "v", "i", "j", "fp")]
        if keep is not None:
            cols = [np.concatenate(x) for x in zip(keep, cols)]
        new = np.zeros(len(cols[0]), dtype=bool)
        for c in cols[:4]:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        bounds = [0, *cuts.tolist(), len(new)]
        if not last:
            keep = [c[bounds[-2] :] for c in cols]
            bounds.pop()
        edges: list[tuple[int, int]] = []
        fps = cols[4].view(np.uint64)
        for lo, hi in zip(bounds, bounds[1:]):
            if hi - lo > 1:
                edges += forest(np.unique(fps[lo:hi]))
        if edges:
            a = np.array(edges, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    held = None
    for b in batches:
        if b.num_rows:
            if held is not None:
                yield False, held
            held = b
    if held is not None:
        yield True, held


def links(nodes: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """Edges (``a``, ``b``) that connect exactly the linked fingerprints among distinct ``fp``."""
    masks = block_masks()
    keyed = nodes.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("k", "v"))
    busy = keyed.groupBy("k", "v").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices"), F.count(F.lit(1)).alias("n"))
    met = keyed.join(busy.filter("n > 1").drop("n"), ["k", "v"])
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    tiles = met.withColumn("own", own).select(
        "k", "v", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other")
    )
    tiles = tiles.select("k", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    dealt = tiles.repartition("k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j")
    return dealt.mapInArrow(_forests, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``fp`` and ``component_id``, the smallest id among the documents it is linked to, directly or not."""
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("rep")), "nodes")
    return placed(prints, nodes, links(nodes.select("fp")), id_col)


def placed(prints: DataFrame, nodes: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """Id, ``fp`` and ``component_id`` of all ``prints`` (id, ``fp``), from the distinct ``nodes`` (``fp``, ``rep``) and the links between them."""
    roots = components(edges)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    Rows that share that id are one document and stay together; rows with a null id
    stay only where their component has no other id.
    """
    return kept(docs, near_duplicates(docs, id_col, text_col), id_col)


def kept(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id names their component in ``found``. Texts stay where they are: only the ids that go are looked up."""
    names = F.bool_or(F.col(id_col).eqNullSafe(F.col("component_id"))).alias("names")
    return without(docs, found.groupBy(id_col).agg(names).filter(~F.col("names")).select(id_col), id_col)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}

"""Benchmark decontamination by greedy string tiling.

Words are compared (runs of letters, digits and underscores, case-folded, as 64-bit hashes). For each document and
test item that may share enough, running Karp-Rabin finds the longest runs of words that both have, of ``TILE`` words
or more; they are marked as tiles, and the search goes on among what is unmarked, with falling length, until
nothing of ``TILE`` words is left. Tiles never overlap on either side and need not be in order, so moved
sentences still count. A pair whose tiles cover ``COVERAGE`` of the item's words is a leak.

Candidates cannot miss a leak. Tiles of three words or more that cover a share of an item's n words hold at least
share * n / 3 of its runs of ``TILE`` words (seeds), which bounds from below how many different seeds a leak shares (``least_seeds``).
So a document is a suspect only if it has as many seeds of the benchmark as the least demanding item asks for, and a pair
meets on any of the item's rarest seeds, of which one is left out less than it asks for: the most common ones never join.
Only words inside seeds can be in tiles, and only those of suspects are kept.

The items' seeds are known to the scan as a Bloom filter that follows their number up to ``FILTER_BITS``; a false
hit costs a look, as pairs meet by exact seeds.

Defined results: null texts are read as empty; items of fewer than ``TILE`` words cannot leak; ids may be of any type,
and null ids stay null; repeated rows are examined each and equal (document, item) pairs are reported once, with
their best coverage; an empty table gives no rows; other columns are ignored. Nothing is grouped by document or item
before the tiling, so neither can be hot; the join on seeds is an inner join that adaptive execution can split. Time and
memory of a tiling are linear in both texts for each length of tile that occurs, also where words repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.llm.bitmap import bits_for, build, contains
from meterlake.llm.lookup import without
from meterlake.llm.shared import materialize, text_of
from meterlake.sources.tables import table

TILE, COVERAGE = 3, 0.8
#: Bits of the seeds' filter, at most.
FILTER_BITS = 1 << 28
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_WORD = re.compile(r"\w+")


class Hashes(dict):
    """Words to 64-bit hashes, computed once each."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Runs:
    """Hashes of all runs of any length of a text's words: sums over prefixes, brought to one place by powers of the base."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        power = np.full(len(words) + 1, _BASE, dtype=np.uint64)
        back = np.full(len(words) + 1, _BACK, dtype=np.uint64)
        power[0] = back[0] = 1
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words * np.multiply.accumulate(power)[:-1], dtype=np.uint64)))
        self.back = np.multiply.accumulate(back)

    def of(self, n: int) -> np.ndarray:
        """By start: the hash of the ``n`` words from there."""
        m = max(len(self.words) - n + 1, 0)
        h = (self.sums[n : n + m] - self.sums[:m]) * self.back[:m]
        h ^= h >> np.uint64(32)
        return h * np.uint64(_BASE)


def seeds_of(words: np.ndarray) -> np.ndarray:
    return Runs(words).of(TILE)


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Starts of runs of ``n`` unmarked words."""
    taken = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(taken[n:] == taken[: len(taken) - n])


def tiles(doc: np.ndarray, item: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, length), longest first, then by start in doc and in item."""
    a, b = Runs(doc), Runs(item)
    in_doc, in_item = np.zeros(len(doc), dtype=bool), np.zeros(len(item), dtype=bool)
    found: list[tuple[int, int, int]] = []

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of unmarked runs of ``n`` words on both sides, with hashes, as far as the other side has the same hash."""
        p, i = _free(in_doc, n), _free(in_item, n)
        x, y = a.of(n)[p], b.of(n)[i]
        some = np.isin(x, y)
        return p[some], x[some], i, y

    most = min(len(doc), len(item))
    while most >= least:
        low, high = least - 1, most
        while low < high:  # the longest length at which anything is left in common
            n = (low + high + 1) // 2
            low, high = (n, high) if len(common(n)[0]) else (low, n - 1)
        if low < least:
            break
        most = low - 1
        p, x, i, y = common(low)
        order = np.argsort(y, kind="stable")
        i, y = i[order], y[order]
        begin, end = np.searchsorted(y, x), np.searchsorted(y, x, side="right")
        cursor: dict[int, int] = {}
        past = 0
        for at, lo, hi in zip(p.tolist(), begin.tolist(), end.tolist()):
            if at < past:
                continue
            k = cursor.get(lo, lo)
            while k < hi and in_item[i[k] : i[k] + low].any():  # marks stay, so what is passed over is passed for good
                k += 1
            cursor[lo] = k
            for j in i[k:hi].tolist():
                if not in_item[j : j + low].any() and np.array_equal(doc[at : at + low], item[j : j + low]):
                    found.append((at, j, low))
                    in_doc[at : at + low] = in_item[j : j + low] = True
                    past = at + low
                    break
    return found


def least_seeds(seeds: np.ndarray, words: int, coverage: float = COVERAGE) -> int:
    """How many different ones of its seeds an item of so many words shares at least with a text that it leaks into."""
    runs = ceil(coverage * words / TILE - 1e-9)
    often = np.sort(np.unique(seeds, return_counts=True)[1])[::-1]
    return max(1, int(np.searchsorted(np.cumsum(often), runs)) + 1)


def _items(benchmark: DataFrame, coverage: float) -> DataFrame:
    """Items of ``TILE`` words or more: a number of their own, id, words, different seeds, and the least of them in a leak."""
    rows = benchmark.select(benchmark["item_id"], text_of(benchmark["text"]).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at = Hashes(), TaskContext.get().partitionId() << 36
        for b in batches:
            words = [hashes.of(t) for t in b.column("text").to_pylist()]
            kept = [n for n, w in enumerate(words) if len(w) >= TILE]
            seeds = [seeds_of(words[n]) for n in kept]
            cols = [
                pa.array([at + n for n in kept], pa.int64()),
                b.column("item_id").take(pa.array(kept, pa.int64())),
                pa.array([words[n].tobytes() for n in kept], pa.binary()),
                pa.array([np.unique(x).view(np.int64) for x in seeds], pa.list_(pa.int64())),
                pa.array([least_seeds(x, len(words[n]), coverage) for n, x in zip(kept, seeds)], pa.int64()),
            ]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays(cols, ["item", "item_id", "words", "seeds", "least"])

    return rows.mapInArrow(run, f"item bigint, item_id {kind}, words binary, seeds array<bigint>, least bigint")


def _suspects(docs: DataFrame, id_col: str, text_col: str, bitmap: np.ndarray, least: int) -> DataFrame:
    """Documents with ``least`` different seeds or more in the filter: a row id, the id, the words in seeds, and the seeds."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = Hashes(), shared.value
        row = TaskContext.get().partitionId() << 36
        gap = np.zeros(1, dtype=np.uint64)  # a word of no text, so that runs end between pieces
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                words = [hashes.of(t) for t in part.column("text").to_pylist()]
                runs = [seeds_of(w) for w in words]
                hit = contains(bits, np.concatenate(runs))
                kept, blobs, seeds = [], [], []
                for n, at in enumerate(np.split(hit, np.cumsum([len(r) for r in runs[:-1]]))):
                    hits = np.flatnonzero(at)
                    if len(hits) < least or len(own := np.unique(runs[n][hits])) < least:
                        continue
                    cuts = np.flatnonzero(np.diff(hits) > TILE) + 1
                    pieces = [words[n][x[0] : x[-1] + TILE] for x in np.split(hits, cuts)]
                    kept.append(n)
                    blobs.append(b"".join(x.tobytes() for piece in pieces for x in (piece, gap)))
                    seeds.append(own.view(np.int64))
                if kept:
                    cols = [pa.array([row + n for n in kept], pa.int64()), part.column("id").take(pa.array(kept)), pa.array(blobs, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, ["row", "id", "words", "seeds"])
                row += part.num_rows

    return rows.mapInArrow(run, f"row bigint, id {kind}, words binary, seeds array<bigint>").withColumnRenamed("id", id_col)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE
) -> DataFrame:
    """Leaks: id, ``item_id``, ``item_words``, ``n_tiles``, ``matched_words`` and ``coverage`` of each (document, item) pair."""
    items = materialize(_items(benchmark, coverage), "items")
    seeds = items.select("item", "least", F.size("seeds").alias("of"), F.explode("seeds").alias("seed"))
    distinct = seeds.select(F.col("seed").alias("key"), F.lit(0).alias("lo"), F.lit(0).alias("hi")).distinct()
    bitmap = build(distinct, bits_for(distinct.count(), FILTER_BITS))
    least = items.agg(F.min("least")).first()[0] or 1
    suspects = materialize(_suspects(docs, id_col, text_col, bitmap, least), "suspects")
    common = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("n", "seed"))  # one item's seeds
    rare = seeds.join(common, "seed").withColumn("rank", rank).filter(F.col("rank") <= F.col("of") - F.col("least") + 1).select("item", "seed")
    met = suspects.select("row", F.explode("seeds").alias("seed")).join(rare, "seed").select("row", "item").distinct()
    pairs = (
        met.join(items.select("item", "item_id", F.col("words").alias("asked"), "least"), "item")
        .join(suspects.select("row", F.col(id_col).alias("id"), F.col("words").alias("doc")), "row")
        .select("id", "item_id", "doc", "asked", "least")
    )
    kind, item_kind = (pairs.schema[c].dataType.simpleString() for c in ("id", "item_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, kept = [], []
            for n, (doc, item, enough) in enumerate(zip(b.column("doc"), b.column("asked"), b.column("least").to_pylist())):
                doc, item = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (doc, item))
                own = np.unique(seeds_of(item))
                if np.isin(own, seeds_of(doc)).sum() >= enough:
                    got = tiles(doc, item)
                    found.append((len(item), len(got), sum(x[2] for x in got)))
                    kept.append(n)
            cols = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 3
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("item_id").take(at), *cols], ["id", "item_id", "item_words", "n_tiles", "matched_words"])

    tiled = pairs.mapInArrow(run, f"id {kind}, item_id {item_kind}, item_words bigint, n_tiles bigint, matched_words bigint")
    leaks = tiled.filter(F.col("matched_words") >= F.lit(coverage) * F.col("item_words") - 1e-9)
    best = leaks.groupBy("id", "item_id").agg(F.max_by(F.struct("item_words", "n_tiles", "matched_words"), F.struct("matched_words", "n_tiles")).alias("x"))
    return best.select(
        F.col("id").alias(id_col), "item_id", "x.item_words", "x.n_tiles", "x.matched_words", (F.col("x.matched_words") / F.col("x.item_words")).alias("coverage")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a test item. Texts stay where they are: only the ids that go are looked up."""
    return without(docs, contamination(docs, benchmark, id_col, text_col).select(id_col), id_col)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) leak."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE_SQL: dict[str, str] = {}

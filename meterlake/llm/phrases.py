"""Phrase collocations by vertically partitioned suffix trees over words.

The tree of all suffixes of all pieces of text, cut at ``DEPTH`` words, is never built as one. Its top is partitioned by prefixes:

1. Prefixes of one word are counted, then those of two whose words are both frequent. A prefix under ``LEAST`` has no candidate below it, so
   its branch ends there. A prefix with more suffixes than the memory ``BUDGET`` is lengthened by a word and counted again, until
   it fits or has full depth.
2. Prefixes are packed into groups whose suffixes fit the budget together: groups are ranges of the prefixes' hashes, cut where the sum of
   their counts would pass it, so a task finds a suffix's group with the list of cuts.
3. Suffixes, cut where the next pair of words is not frequent, go to their groups; a task sums equal ones before they move. In each
   group the subtree is built by itself: sorted suffixes, whose runs of equal first words are the nodes of each depth. A node's count is the sum
   of its leaves. Only a prefix that was lengthened has nodes in several groups; their counts are added.

Frequent words and pairs are found by Bloom filters of bounded size; what a filter lets through by mistake has its true count in the tree
and is left out there. Words, with their language, are 64-bit hashes until the best phrases are known; only those get their
texts back. Counts and products are exact (decimals beyond 64 bits).

Scores, per language: a phrase of 2 to 4 words seen a times, cut after its first k words into parts seen l and r times, has
floor(2000000 * a / (l + r)) for that cut, and the lowest of its cuts counts, at a tie the smallest k. A candidate whose words lie inside a longer one with at least 80 %
of its count is dropped.

Defined results: null text is read as empty, a null language as ``und``; repeated rows count each; equal scores are ordered by count, then by
the phrase's bytes; an empty table, or one without frequent phrases, gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.llm.bitmap import bits_for, build, contains
from meterlake.llm.shared import materialize, text_of
from meterlake.llm.words import BASE, mixed, slices
from meterlake.sources.tables import table

LEAST, DEPTH, TOP = 30, 4, 2000
#: Per cent of a candidate's count that a longer one around it needs.
INSIDE = 80
#: Suffixes of a group, records that a task sums before it passes them on, characters of text whose prefixes are summed together.
BUDGET, FLUSH, PART_CHARS = 1 << 20, 1 << 20, 1 << 22
#: Bytes of text that a task takes at a time.
SLICE = 1 << 20
#: Bits of a filter at most (32 MB); ranges of hashes that counts are collected for, at most, as a power of two.
FILTER_BITS, RANGES = 1 << 28, 20

#: Bytes that end a piece (2) or a word (1); a number for each byte, the same for both cases of a letter.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_NUMBER = np.random.default_rng(12).integers(0, 1 << 64, 256, dtype=np.uint64)
_NUMBER[ord("A") : ord("Z") + 1] = _NUMBER[ord("a") : ord("z") + 1]


@dataclass(frozen=True)
class Words:
    """Words of several texts: keys (of language and word), is the next one in the same piece, text, and bytes from and to in ``raw``."""

    keys: np.ndarray
    joined: np.ndarray
    row: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    raw: np.ndarray


def words_of(texts: pa.Array, langs: pa.Array) -> Words:
    import xxhash

    wide = texts.cast(pa.large_string())
    at = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(wide.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    kind = _CLASS[raw]
    inner = kind == 0
    first, last = inner.copy(), inner.copy()
    first[1:] &= ~inner[:-1]
    last[:-1] &= ~inner[1:]
    seams = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    first[seams] = inner[seams]  # a word ends with its text
    last[seams - 1] = inner[seams - 1]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(lo):
        none = np.zeros(0, dtype=np.int64)
        return Words(none.view(np.uint64), np.zeros(0, dtype=bool), none, none, none, raw)
    row = np.searchsorted(at, lo, side="right") - 1
    place = np.arange(lo[0], len(raw)) - np.repeat(lo, np.diff(np.append(lo, len(raw))))
    powers = np.full(int((hi - lo).max()) + 1, BASE, dtype=np.uint64)
    powers[0] = 1
    value = _NUMBER[raw[lo[0] :]] * np.multiply.accumulate(powers)[np.minimum(place, len(powers) - 1)]
    value[~inner[lo[0] :]] = 0
    coded = langs.dictionary_encode()
    names = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    lang = names[coded.indices.to_numpy(zero_copy_only=False)]
    keys = mixed(mixed(np.add.reduceat(value, lo - lo[0])) + lang[row]) | np.uint64(1)  # 0 stands for no word
    breaks = np.cumsum(kind == 2)[lo]
    joined = np.zeros(len(lo), dtype=bool)
    joined[:-1] = (breaks[1:] == breaks[:-1]) & (row[1:] == row[:-1])
    return Words(keys, joined, row, lo, hi, raw)


def _longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of prefixes that are one word longer."""
    return mixed(prefix * BASE + word)


def _texts(w: Words, some: np.ndarray) -> pa.Array:
    """The texts of some words, A-Z lower-cased."""
    size = w.hi[some] - w.lo[some]
    ends = np.concatenate(([0], np.cumsum(size)))
    taken = w.raw[np.repeat(w.lo[some] - ends[:-1], size) + np.arange(ends[-1])].copy()
    taken[(taken >= ord("A")) & (taken <= ord("Z"))] += 32
    return pa.Array.from_buffers(pa.string(), len(some), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(taken.tobytes())])


def word_counts(rows: DataFrame, least: int) -> DataFrame:
    """``key``, ``lang``, ``word``, ``n`` of frequent words; and a row for each language with null as word, and all its words as ``n``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            keys, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            different, at, back = np.unique(keys, return_index=True, return_inverse=True)
            langs, words = (pa.concat_arrays([h[i] for h in held]).take(pa.array(at)) for i in (2, 3))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(different.view(np.int64)), langs, words, pa.array(np.bincount(back, weights=n).astype(np.int64))], ["key", "lang", "word", "n"])

        for b in batches:
            for part in slices(b, most=SLICE):
                w = words_of(part.column("text"), part.column("lang"))
                if not len(w.keys):
                    continue
                different, at, n = np.unique(w.keys, return_index=True, return_counts=True)
                held.append((different, n, part.column("lang").take(pa.array(w.row[at])), _texts(w, at)))
                by_row = np.bincount(w.row, minlength=part.num_rows)
                sums = pa.table({"lang": part.column("lang"), "n": pa.array(by_row)}).group_by("lang").aggregate([("n", "sum")])
                nothing = pa.nulls(len(sums), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sums), np.int64)), sums["lang"].combine_chunks(), nothing, sums["n_sum"].combine_chunks()], ["key", "lang", "word", "n"])
                if sum(len(h[0]) for h in held) > FLUSH:
                    yield flush()
        if held:
            yield flush()

    found = rows.mapInArrow(scan, "key bigint, lang string, word string, n bigint").groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))
    return found.filter((F.col("n") >= least) | F.col("word").isNull())


def _filter(keys: DataFrame) -> np.ndarray:
    return build(keys.select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi")), bits_for(keys.count(), FILTER_BITS))


def _among(some: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    if not len(some):
        return np.zeros(len(keys), dtype=bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def _pooled(records: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], part_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """Counts records (keys, and rows of numbers), task by task; yields runs of them by part."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            key, rows, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            key, at, back = np.unique(key, return_index=True, return_inverse=True)
            rows, n = rows[at], np.bincount(back, weights=n).astype(np.int64)
            part = part_of(key, rows)
            order = np.argsort(part, kind="stable")
            part, rows, n = part[order], rows[order], n[order]
            lo = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            cuts = [*lo.tolist(), len(part)]
            blobs = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for x in (rows, n.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array(part[lo].astype(np.int64)), *blobs], ["part", "rows", "counts"])

        for b in batches:
            for part in slices(b, most=SLICE):
                key, rows = records(part)
                if not len(key):
                    continue
                key, at, n = np.unique(key, return_index=True, return_counts=True)
                held.append((key, rows[at], n))
                if sum(len(h[0]) for h in held) > FLUSH:
                    yield flush()
        if held:
            yield flush()

    return scan


def _by_part(found: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], width: int) -> Callable:
    """Runs ``found`` on the rows (``width`` numbers each) and counts of one part after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, counts = None, [], []

        def close() -> pa.RecordBatch:
            all_rows, n = np.frombuffer(b"".join(rows), dtype=np.uint64).reshape(-1, width), np.frombuffer(b"".join(counts), dtype=np.uint32).astype(np.int64)
            rows.clear(), counts.clear()
            return found(all_rows, n)

        for b in batches:
            for part, r, n in zip(b.column("part").to_pylist(), b.column("rows"), b.column("counts")):
                if part != now and rows:
                    yield close()
                now = part
                rows.append(r.as_py()), counts.append(n.as_py())
        if rows:
            yield close()

    return run


def _dealt(rows: DataFrame, scan: Callable) -> DataFrame:
    return rows.mapInArrow(scan, "part bigint, rows binary, counts binary").repartition("part").sortWithinPartitions("part")


@dataclass(frozen=True)
class Gates:
    """What is known when a pass begins: filters of frequent words and pairs, prefixes that are lengthened (sorted keys by depth), cuts between groups."""

    words: np.ndarray
    pairs: np.ndarray | None
    long: dict[int, np.ndarray]
    cuts: np.ndarray | None


def _pairs(w: Words, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of frequent words, and the pairs' keys."""
    good = contains(words, w.keys)
    at = np.flatnonzero(good[:-1] & good[1:] & w.joined[:-1]) if len(good) else np.zeros(0, dtype=np.int64)
    return at, _longer(w.keys[at], w.keys[at + 1]) if len(at) else np.zeros(0, dtype=np.uint64)


def suffixes(w: Words, g: Gates) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that begin with a frequent pair: keys of their prefixes of 2, 3 and 4 words, and their words (0 behind their end)."""
    at, key = _pairs(w, g.words)
    kept = contains(g.pairs, key)
    at, key = at[kept], key[kept]
    out = np.zeros((len(at), DEPTH), dtype=np.uint64)
    pair = np.zeros(len(w.keys) + DEPTH, dtype=bool)
    pair[at] = True
    padded = np.append(w.keys, np.zeros(DEPTH, dtype=np.uint64))
    goes_on = np.ones(len(at), dtype=bool)
    out[:, 0] = padded[at]
    prefixes = np.zeros((len(at), DEPTH - 1), dtype=np.uint64)
    for d in range(1, DEPTH):
        goes_on = goes_on & pair[at + d - 1]
        out[:, d] = np.where(goes_on, padded[at + d], 0)
        prefixes[:, d - 1] = key if d == 1 else _longer(prefixes[:, d - 2], out[:, d])
    return prefixes, out


def _partition_keys(prefixes: np.ndarray, g: Gates) -> np.ndarray:
    """The key of the prefix that a suffix is dealt by: two words, or as many more as the prefix was lengthened by."""
    key = prefixes[:, 0].copy()
    long = np.ones(len(key), dtype=bool)
    for depth in range(2, DEPTH):
        long = long & _among(g.long.get(depth, np.zeros(0, dtype=np.uint64)), prefixes[:, depth - 2])
        key[long] = prefixes[long, depth - 1]
    return key


def prefix_counts(rows: DataFrame, g: Gates, depth: int, least: int, parts: int) -> DataFrame:
    """``key`` and ``n`` of prefixes of ``depth`` words (all pairs of frequent words, or below lengthened prefixes) seen ``least`` times or more."""
    shared = rows.sparkSession.sparkContext.broadcast(g)

    def records(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        w = words_of(b.column("text"), b.column("lang"))
        if depth == 2:
            _, key = _pairs(w, shared.value.words)
        else:
            prefixes, _ = suffixes(w, shared.value)
            key = prefixes[_among(shared.value.long[depth - 1], prefixes[:, depth - 3]), depth - 2]
        return key, key

    def total(rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        key, back = np.unique(rows[:, 0], return_inverse=True)
        n = np.bincount(back, weights=n).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key[n >= least].view(np.int64)), pa.array(n[n >= least])], ["key", "n"])

    part_of = lambda key, _: (mixed(key) >> np.uint64(20)) % np.uint64(parts)
    return _dealt(rows, _pooled(records, part_of)).mapInArrow(_by_part(total, 1), "key bigint, n bigint")


def group_cuts(prefixes: DataFrame, budget: int) -> np.ndarray:
    """Where ranges of hashes (``key``, with ``n`` suffixes each) are cut, so that what lies between two cuts fits ``budget``.

    The driver gets a row for each of ``2 ** RANGES`` ranges at most.
    """
    whole = prefixes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(RANGES, max(1, int(whole * 8 // budget).bit_length()))
    found = prefixes.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("range")).agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(1 << bits, dtype=np.int64)
    sums[found.column("range").to_numpy()] = found.column("n").to_numpy()
    cuts, held = [], 0
    for r in np.flatnonzero(sums).tolist():
        if held and held + sums[r] > budget:
            cuts.append(r << (64 - bits))
            held = 0
        held += int(sums[r])
    return np.array(cuts, dtype=np.uint64)


_NODE = "w1 w2 w3 w4 p12 p23 p34 p123 p234 key".split()
_NODES = ", ".join(f"{c} bigint" for c in _NODE) + ", depth int, n bigint"


def _subtree(least: int, long: dict[int, np.ndarray]) -> Callable[[np.ndarray, np.ndarray], pa.RecordBatch]:
    """The nodes of two words or more of a group's suffixes, with the sums of their leaves."""

    def found(rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort(rows.T[::-1])
        rows, n = rows[order], n[order]
        new = np.zeros(len(rows), dtype=bool)
        new[0] = True
        cols: list[list[np.ndarray]] = [[] for _ in range(len(_NODE) + 2)]
        for depth in range(1, DEPTH + 1):
            new[1:] |= rows[1:, depth - 1] != rows[:-1, depth - 1]
            if depth == 1:
                continue
            starts = np.flatnonzero(new)
            total = np.add.reduceat(n, starts)
            node = rows[starts].copy()
            node[:, depth:] = 0
            there = node[:, depth - 1] != 0
            node, total = node[there], total[there]
            w1, w2, w3, w4 = node.T
            p12, p23, p34 = _longer(w1, w2), _longer(w2, w3), _longer(w3, w4)
            p123, p234 = _longer(p12, w3), _longer(p23, w4)
            key = (p12, p123, _longer(p123, w4))[depth - 2]
            kept = (total >= least) | _among(long.get(depth, np.zeros(0, dtype=np.uint64)), key)
            for held, c in zip(cols, (w1, w2, w3, w4, p12, p23, p34, p123, p234, key)):
                held.append(c[kept].view(np.int64))
            cols[-2].append(np.full(int(kept.sum()), depth, dtype=np.int32))
            cols[-1].append(total[kept])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], [*_NODE, "depth", "n"])

    return found


def phrase_counts(rows: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Counts of words (as of ``word_counts``) and of all phrases of 2 to 4 words seen ``least`` times or more: words ``w1`` to ``w4``, keys of the phrase and of its parts, ``depth``, ``n``."""
    spark = rows.sparkSession
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    parts = 1 + size // PART_CHARS
    words = materialize(word_counts(rows, least), "words")
    gates = Gates(_filter(words.filter("word IS NOT NULL")), None, {}, None)
    prefixes = materialize(prefix_counts(rows, gates, 2, least, parts), "prefixes")
    gates = Gates(gates.words, _filter(prefixes), {}, None)
    by_depth, depth = prefixes.filter(F.col("n") <= budget), 2
    while True:
        over = prefixes.filter(F.col("n") > budget)  # the number of suffixes through the budget, at most
        long = np.sort(over.select("key").toArrow().column("key").to_numpy().view(np.uint64))
        if not len(long):
            break
        gates.long[depth] = long
        depth += 1
        prefixes = materialize(prefix_counts(rows, gates, depth, 1, parts), "prefixes")
        by_depth = by_depth.union(prefixes.filter(F.col("n") <= budget) if depth < DEPTH else prefixes)
        if depth == DEPTH:
            break
    gates = Gates(gates.words, gates.pairs, gates.long, group_cuts(by_depth, budget))
    shared = spark.sparkContext.broadcast(gates)

    def records(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        prefixes, out = suffixes(words_of(b.column("text"), b.column("lang")), shared.value)
        return prefixes[:, -1], np.column_stack([out, _partition_keys(prefixes, shared.value)])

    def part_of(key: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(shared.value.cuts, rows[:, -1], side="right")

    build_tree = _subtree(least, gates.long)
    tree = lambda rows, n: build_tree(rows[:, :DEPTH], n)
    nodes = _dealt(rows, _pooled(records, part_of)).mapInArrow(_by_part(tree, DEPTH + 1), _NODES)
    whole = nodes.groupBy(*_NODE, "depth").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return words, materialize(whole, "phrases")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, inside: int = INSIDE, budget: int = BUDGET) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    rows = docs.select(text_of(docs[text_col]).alias("text"), F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"))
    words, phrases = phrase_counts(rows, least, budget)
    named = words.filter("word IS NOT NULL")
    counts = named.select("key", "n", "lang").union(phrases.filter("depth < 4").select("key", "n", F.lit(None).cast("string").alias("lang")))

    wide = lambda c: F.col(c).cast("decimal(19,0)")
    around = F.when(F.col("depth") == 3, F.array("p12", "p23")).when(F.col("depth") == 4, F.array("p12", "p23", "p34", "p123", "p234"))
    covers = phrases.filter("depth > 2").select(F.explode(around).alias("key"), F.col("n").alias("longer"))
    covers = covers.groupBy("key").agg(F.max("longer").alias("longer"))
    free = phrases.join(covers, "key", "left").filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("n") * inside))

    cut = lambda k, first, rest: F.struct(F.lit(k).alias("k"), F.col(first).alias("first"), F.col(rest).alias("rest"))
    cuts = (
        F.when(F.col("depth") == 2, F.array(cut(1, "w1", "w2")))
        .when(F.col("depth") == 3, F.array(cut(1, "w1", "p23"), cut(2, "p12", "w3")))
        .otherwise(F.array(cut(1, "w1", "p234"), cut(2, "p12", "p34"), cut(3, "p123", "w4")))
    )
    each = free.select("key", "w1", "w2", "w3", "w4", "n", F.explode(cuts).alias("x")).select("key", "w1", "w2", "w3", "w4", F.col("n").alias("a"), "x.*")
    each = each.join(counts.select(F.col("key").alias("first"), F.col("n").alias("l"), "lang"), "first")
    each = each.join(counts.select(F.col("key").alias("rest"), F.col("n").alias("r")), "rest")
    score = F.expr("(CAST(a AS DECIMAL(19,0)) * CAST(2000000 AS DECIMAL(7,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    best = each.groupBy("key", "w1", "w2", "w3", "w4", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"), F.max("lang").alias("lang"))
    best = best.select("lang", "w1", "w2", "w3", "w4", "a", "best.*")

    order = [F.col("score").desc(), F.col("a").desc()]
    first = best.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top)
    first = materialize(first, "first")  # with all that tie with the last one
    one = first.select("w1", "w2", "w3", "w4", F.posexplode(F.array("w1", "w2", "w3", "w4")).alias("pos", "key")).filter("key <> 0")
    spelt = one.join(named.select("key", "word"), "key").groupBy("w1", "w2", "w3", "w4").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("words"))
    spelt = spelt.withColumn("phrase", F.array_join(F.col("words.word"), " "))
    ranked = first.join(spelt, ["w1", "w2", "w3", "w4"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("bigint"))
    totals = words.filter("word IS NULL").select("lang", "n")
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM d
), runs AS (
  SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS g
  FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS s(m) WHERE len(words) >= m)
), f AS (
  SELECT lang, m, g, count(*) AS n FROM runs GROUP BY ALL
), c AS (
  SELECT lang, m, g, n AS a, string_split(g, ' ') AS words FROM f WHERE m > 1 AND n >= 30
), part AS (
  SELECT lang, a, words, m, unnest(range(1, m)) AS i FROM c WHERE m > 2
), inside AS (
  SELECT lang, g, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(words[i:i + s - 1], ' ') AS g FROM part, (VALUES (2), (3)) AS t(s) WHERE s < m AND i + s - 1 <= m
  ) GROUP BY lang, g
), cut AS (
  SELECT c.lang, c.g, c.a, k, array_to_string(c.words[1:k], ' ') AS first, array_to_string(c.words[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c LEFT JOIN inside USING (lang, g)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * c.a
), scored AS (
  SELECT cut.lang, cut.g AS phrase, a, k, x.n AS l, y.n AS r, (2000000::HUGEINT * a) // (x.n + y.n) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.g = cut.first JOIN f y ON y.lang = cut.lang AND y.g = cut.rest
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.g ORDER BY score, k) = 1
), total AS (
  SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM scored JOIN total USING (lang) QUALIFY rank <= 2000
"""

QUERIES = {"op12_phrase_collocations": op12_phrase_collocations}
ORACLE_SQL = {"op12_phrase_collocations": _SQL}

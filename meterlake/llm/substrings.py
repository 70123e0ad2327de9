"""Repeated passages across documents, by suffix trees over prefix groups.

A passage repeats if ``WINDOW`` words in a row also start in a document with a smaller
id. All suffixes of all documents would be a tree far larger than the input, so:

1. Suffixes are grouped by a prefix of ``PREFIX`` words, and only from anchors: of the
   prefixes that start inside a window, the one with the smallest hash. Equal
   windows have their anchor at the same place, so they meet in one group. Prefixes that
   occur in one document only are leaves and go no further.
2. Prefix counts set how far a group is split. A prefix of more than ``GROUP`` anchors is lengthened word by word: one pass counts its suffixes by
   their first 6, 7, and so on up to ``WINDOW`` words, summed by task, and each suffix takes the shortest prefix that is not too large. As no prefix splits
   copies of one passage, suffixes of a prefix that has full depth and is still too large are dealt over 64 parts by a hash of
   document and place, those of a 64 times larger one over 4096, and so on; every part fits in memory. A window that holds all words of the lengthened prefix lies whole
   in its part; others (they end before it) may lie in several, and are open.
3. In each group a subtree is grown from the prefix down, word by word: a node's suffixes are sorted by their next word,
   and each run of equal words is a child. A node whose suffixes are of one document is a leaf and not
   grown further. Nodes left at depth ``WINDOW`` are the deep internal ones: all their occurrences but those of the smallest id are
   marked, and neighbouring marks join to maximal repeats. Open nodes are grown to full depth whatever their documents;
   one row for a node and document with all its places goes on, and the smallest document over all parts is found by an aggregation that tasks begin on their own.

Spans are judged on the input and brought to the texts by one join. Suffixes are
held as the 64-bit hashes of each of their words but the prefix's, which a group shares. The map of repeated prefixes is a Bloom filter of bounded size; a false
hit only costs a row that the sort rejects.

Defined results: null text has no words; rows with a null id count as later than all
others, so they lose their repeats to any document and take none from one; rows with
the same id and text share one result, and repeats within one id are kept; an empty table gives
no rows; ids must be integers; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.bitmap import bits_for, build, contains
from meterlake.llm.shared import materialize, text_of
from meterlake.llm.words import BASE, hash_values, mixed, rolling, same_text, slices, split_words
from meterlake.sources.tables import table

WINDOW, PREFIX = 13, 5
#: Anchors of one group that a task holds at a time, and parts that a larger group is split into.
GROUP, PARTS = 1 << 12, 64
#: Neighbouring places of a document that go to one part.
STRETCH = 1 << 10
#: Bits of the map of repeated prefixes, at most (32 MB).
MAP_BITS = 1 << 28
_LAST = (1 << 63) - 1


def _anchored(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Hashes of all words of all texts; and of all windows: row, the text's first word, place, anchor's hash, anchor's place, and the text's end (places in the batch)."""
    words, offsets = split_words(texts)
    hashes = hash_values(words)
    prefixes = rolling(hashes, PREFIX)
    inside = np.flatnonzero(same_text(offsets, WINDOW))
    windows = max(len(hashes) - WINDOW + 1, 0)
    least = prefixes[:windows].copy()
    place = np.zeros(windows, dtype=np.int64)
    for k in range(1, WINDOW - PREFIX + 1):
        other = prefixes[k : k + windows]
        smaller = other < least
        np.copyto(least, other, where=smaller)
        place[smaller] = k
    place += np.arange(windows)
    row = np.searchsorted(offsets, inside, side="right") - 1
    return hashes, row, offsets[row], inside, least[inside], place[inside], offsets[row + 1]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.coalesce(docs[id_col].cast("bigint"), F.lit(_LAST))
    return docs.select(docs[id_col].alias("id"), key.alias("doc"), text_of(docs[text_col]).alias("text"))


def repeated_prefixes(rows: DataFrame) -> DataFrame:
    """Anchors' prefixes ``a`` that start in two documents or more, with their number of anchors ``n``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                doc = part.column("doc").to_numpy()
                _, row, _, _, anchor, place, _ = _anchored(part.column("text"))
                if not len(row):
                    continue
                first = np.concatenate(([True], place[1:] != place[:-1]))
                anchor, doc = anchor[first].view(np.int64), doc[row[first]]
                order = np.lexsort((doc, anchor))
                anchor, doc = anchor[order], doc[order]
                lo = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
                hi = np.concatenate((lo[1:], [len(anchor)])) - 1
                two = doc[lo] != doc[hi]
                n = np.concatenate((hi - lo + 1, np.zeros(two.sum(), dtype=np.int64)))
                at = np.concatenate((lo, hi[two]))
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at]), pa.array(doc[at]), pa.array(n)], ["a", "doc", "n"])

    # rows are summed per batch above and hardly repeat otherwise: dealing them by key first leaves one pass of aggregation
    found = rows.mapInArrow(scan, "a bigint, doc bigint, n bigint").repartition("a").groupBy("a")
    return found.agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.sum("n").alias("n")).filter("lo < hi").select("a", "n")


def _keys(prefixes: DataFrame) -> DataFrame:
    return prefixes.select(F.col("a").alias("key"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))


#: A window that begins ``open`` words before its anchor, or more, may have equals in other parts.
_SUFFIX = "a bigint, part bigint, open bigint, doc bigint, tag bigint, start bigint, around bigint, words binary"
#: Words that a prefix can be lengthened by.
_LONGER = WINDOW - PREFIX


def _lengthened(anchor: np.ndarray, place: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Hashes of anchors' prefixes lengthened by 1 to 8 words of the text (0 behind its end)."""
    out = []
    for k in range(_LONGER):
        next_ = place + PREFIX + k
        anchor = mixed(anchor * BASE + np.where(next_ < end, hashes[np.minimum(next_, len(hashes) - 1)], np.uint64(0)))
        out.append(anchor)
    return out


def large_prefixes(rows: DataFrame, large: np.ndarray, group: int) -> DataFrame:
    """Of the prefixes in the filter ``large``: those lengthened by ``longer`` words (1 to 8) that still have more than ``group`` suffixes, as ``key`` and ``n``."""
    shared = rows.sparkSession.sparkContext.broadcast(large)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                hashes, _, _, _, anchor, place, end = _anchored(part.column("text"))
                first = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, dtype=bool)
                first[first] = contains(shared.value, anchor[first])
                if not first.any():
                    continue
                for k, h in enumerate(_lengthened(anchor[first], place[first], end[first], hashes), 1):
                    key, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), k, dtype=np.int32)), pa.array(n)], ["key", "longer", "n"])

    return rows.mapInArrow(scan, "key bigint, longer int, n bigint").groupBy("key", "longer").agg(F.sum("n").alias("n")).filter(F.col("n") > group)


@dataclass(frozen=True)
class Maps:
    """Filters of repeated prefixes, of large ones, of those that are still large when lengthened (by words, as levels), and of whole windows by the parts that they need."""

    repeated: np.ndarray
    large: np.ndarray
    longer: np.ndarray | None = None
    whole: tuple[np.ndarray, ...] = ()

    def parts(self, anchor: np.ndarray, place: np.ndarray, end: np.ndarray, hashes: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each suffix's part, and how many words before the anchor make a window open there."""
        part, opens = np.zeros(len(anchor), dtype=np.uint64), np.full(len(anchor), WINDOW, dtype=np.int64)
        hot = np.flatnonzero(contains(self.large, anchor)) if self.longer is not None else np.zeros(0, dtype=np.int64)
        if not len(hot):
            return part, opens
        names = _lengthened(anchor[hot], place[hot], end[hot], hashes)
        by, alive = np.zeros(len(hot), dtype=np.int64), np.arange(len(hot))
        for k in range(1, _LONGER + 1):
            by[alive] = k
            alive = alive[contains(self.longer, names[k - 1][alive], k)]
        # the prefix ends so many words behind the anchor's: a window that begins k words before the anchor holds 8 - k of them
        part[hot], opens[hot] = np.column_stack(names)[np.arange(len(hot)), by - 1], _LONGER + 1 - by
        dealt = mixed(mixed(doc[hot].view(np.uint64) * BASE + (start[hot] // STRETCH).astype(np.uint64))) >> np.uint64(8)
        whole = names[-1][alive]
        for level, m in enumerate(self.whole, 1):
            big = contains(m, whole)
            part[hot[alive[big]]] = mixed(whole[big] * BASE + dealt[alive[big]] % np.uint64(PARTS**level))
        opens[hot[alive]] = 0
        return part, opens


def maps_of(rows: DataFrame, group: int, map_bits: int) -> Maps:
    prefixes = materialize(repeated_prefixes(rows), "prefixes")
    count, most = prefixes.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    filtered = lambda keys: build(keys, bits_for(keys.count(), map_bits))
    repeated, large = build(_keys(prefixes), bits_for(count, map_bits)), filtered(_keys(prefixes.filter(F.col("n") > group)))
    if most <= group:
        return Maps(repeated, large)
    still = materialize(large_prefixes(rows, large, group), "large")
    longer = filtered(still.select("key", F.col("longer").alias("lo"), F.col("longer").alias("hi")))
    windows, whole, least = still.filter(F.col("longer") == _LONGER), [], group
    most = windows.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while most > least:
        whole.append(filtered(windows.filter(F.col("n") > least).select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"))))
        least *= PARTS
    return Maps(repeated, large, longer, tuple(whole))


def _suffixes(rows: DataFrame, maps: Maps) -> DataFrame:
    """Neighbouring suffixes by their anchor: prefix, part (0, but for large prefixes), ``open``, document, text's checksum, first start, words before the anchor, and hashes of the words around it."""
    shared = rows.sparkSession.sparkContext.broadcast(maps)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                doc, texts = part.column("doc").to_numpy(), part.column("text")
                hashes, *found = _anchored(texts)
                kept = contains(shared.value.repeated, found[3])
                row, begin, window, anchor, place, end = (x[kept] for x in found)
                if not len(row):
                    continue
                first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                size = np.diff(np.concatenate((first, [len(row)]))) + WINDOW - PREFIX - 1
                row, start, window, anchor, place, end = row[first], (window - begin)[first], window[first], anchor[first], place[first], end[first]
                tags = np.zeros(len(doc), dtype=np.int64)
                for r in np.unique(row).tolist():
                    tags[r] = zlib.crc32(texts[r].as_buffer())
                left = place - window
                run, at = _counted(size)
                around = hashes[window[run] + at + np.where(at < left[run], 0, PREFIX)]
                parts, opens = shared.value.parts(anchor, place, end, hashes, doc[row], start)
                cols = [anchor.view(np.int64), parts.view(np.int64), opens, doc[row], tags[row], start, left]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), _blobs(around, size)], ["a", "part", "open", "doc", "tag", "start", "around", "words"])

    return rows.mapInArrow(scan, _SUFFIX)


def _counted(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes, one after another: each entry's run, and its number in it."""
    run = np.repeat(np.arange(len(size)), size)
    return run, np.arange(len(run)) - (np.cumsum(size) - size)[run]


def _blobs(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """Values of 64 bits in runs of these sizes, as binaries."""
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    return np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))


def _deep_nodes(node: np.ndarray, words: np.ndarray, at: np.ndarray, doc: np.ndarray, meets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes below nodes of full depth, and the smallest document of each one's node.

    ``node``: the nodes to grow from; ``words[at + d]``: the word that a suffix reads at step d. Nodes of one document are
    grown no further, unless they are open (``meets`` > 0).
    """
    steps = WINDOW - PREFIX
    letters, letter = np.unique(words, return_inverse=True)
    alive = np.arange(len(node))
    for step in range(steps + 1):
        if step:
            node = node * len(letters) + letter[at[alive] + step - 1]
        order = np.argsort(node, kind="stable")
        node, alive = node[order], alive[order]
        lo = _starts(node)
        least, most = (f.reduceat(doc[alive], lo) for f in (np.minimum, np.maximum))
        inner = (least != most) | (meets[alive[lo]] > 0)
        child = np.repeat(np.arange(len(lo)), np.diff(np.concatenate((lo, [len(node)]))))
        kept = inner[child]
        alive, node = alive[kept], child[kept]
        if not len(alive):
            break
    return alive, least[node]


#: A span to remove (``lo`` to ``hi``), or a node ``a`` of full depth with the ``places`` where one document has it.
_MARKS = "a bigint, doc bigint, tag bigint, lo bigint, hi bigint, places binary"


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeats of groups that come sorted by (a, part); of parts of groups also what has to meet again (with ``places``)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        a, part = b.column("a").to_numpy(), b.column("part").to_numpy()
        ends = np.flatnonzero((a[1:] != a[:-1]) | (part[1:] != part[:-1])) + 1
        same = bool(held) and held[-1].column("a")[-1].as_py() == a[0] and held[-1].column("part")[-1].as_py() == part[0]
        cut = int(ends[-1]) if len(ends) else 0
        if cut or not same:
            if same or cut:
                yield from _mark(pa.concat_batches([*held, b.slice(0, cut)]) if held else b.slice(0, cut))
            else:
                yield from _mark(pa.concat_batches(held)) if held else ()
            held = []
        held.append(b.slice(cut))
    if held:
        yield from _mark(pa.concat_batches(held))


def _mark(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if not b.num_rows:
        return
    a, part, opens, doc, tag, start = (b.column(c).to_numpy() for c in ("a", "part", "open", "doc", "tag", "start"))
    left, blobs = b.column("around").to_numpy(), b.column("words")
    words = np.frombuffer(b"".join(blobs.to_pylist()), dtype=np.uint64)
    held = np.diff(np.frombuffer(blobs.buffers()[1], dtype=np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]) // 8
    size = held - (WINDOW - PREFIX - 1)
    run, number = _counted(size)
    first = (np.cumsum(held) - held)[run] + number
    group = np.zeros(len(a), dtype=np.int64)
    group[1:] = np.cumsum((a[1:] != a[:-1]) | (part[1:] != part[:-1]))
    before = left[run] - number  # words of a suffix before its anchor
    docs = doc[run]
    at = start[run] + number
    meets = (before >= opens[run]).astype(np.int64)
    alive, least = _deep_nodes(group[run] * WINDOW + before, words, first, docs, meets)
    later = docs[alive] != least

    names = ["a", "doc", "tag", "lo", "hi", "places"]
    hit = alive[later]
    if len(hit):
        hit = hit[np.lexsort((at[hit], tag[run[hit]], docs[hit]))]
        d, t, p = docs[hit], tag[run[hit]], at[hit]
        lo = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] > p[:-1] + WINDOW))))
        hi = np.concatenate((lo[1:], [len(hit)])) - 1
        cols = [d[lo], t[lo], p[lo], p[hi] + WINDOW]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(lo), pa.int64()), *map(pa.array, cols), pa.nulls(len(lo), pa.binary())], names)
    open_ = alive[~later & (meets[alive] > 0)]
    if len(open_):
        name = a[run[open_]].view(np.uint64) * BASE + before[open_].astype(np.uint64)
        for step in range(WINDOW - PREFIX):
            name = name * BASE + words[first[open_] + step]
        name = mixed(name).view(np.int64)
        order = np.lexsort((at[open_], tag[run[open_]], docs[open_], name))
        open_, name = open_[order], name[order]
        keys = name, docs[open_], tag[run[open_]]
        new = _starts(*keys)
        none = pa.nulls(len(new), pa.int64())
        blobs = _blobs(at[open_], np.diff(np.concatenate((new, [len(open_)]))))
        yield pa.RecordBatch.from_arrays([*(pa.array(k[new]) for k in keys), none, none, blobs], names)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of rows with ``places``."""
    for b in batches:
        if not b.num_rows:
            continue
        places = [np.frombuffer(p.as_buffer(), dtype=np.int64) for p in b.column("places")]
        size = [len(p) for p in places]
        lo = np.concatenate(places)
        row = np.repeat(np.arange(b.num_rows), size)
        first = np.concatenate(([True], (row[1:] != row[:-1]) | (lo[1:] > lo[:-1] + WINDOW)))
        last = np.concatenate((np.flatnonzero(first)[1:], [len(lo)])) - 1
        doc, tag = (b.column(c).to_numpy()[row[first]] for c in ("doc", "tag"))
        yield pa.RecordBatch.from_arrays([*map(pa.array, (doc, tag, lo[first], lo[last] + WINDOW))], ["doc", "tag", "lo", "hi"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, map_bits: int = MAP_BITS) -> DataFrame:
    """Spans of words to remove: ``doc`` (the id), ``tag`` (crc32 of the text), ``lo`` and ``hi`` (word positions, end exclusive). Spans may overlap."""
    rows = _rows(docs, id_col, text_col).select("doc", "text")
    dealt = _suffixes(rows, maps_of(rows, group, map_bits)).repartition("a", "part").sortWithinPartitions("a", "part")
    marks = materialize(dealt.mapInArrow(_marks, _MARKS), "marks")
    again = marks.filter("a IS NOT NULL").select("a", "doc", "tag", "places")
    least = again.groupBy("a").agg(F.min("doc").alias("least"))
    later = again.join(least, "a").filter("doc <> least").select("doc", "tag", "places")
    spans = "doc bigint, tag bigint, lo bigint, hi bigint"
    return marks.filter("a IS NULL").select("doc", "tag", "lo", "hi").union(later.mapInArrow(_placed, spans))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, and ``kept``, the words left, joined by a blank."""
    spans = repeated_spans(docs, id_col, text_col).groupBy("doc", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    met = rows.withColumn("tag", F.crc32(F.col("text").cast("binary"))).join(spans, ["doc", "tag"], "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                total, removed, kept = [], [], []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    words = text.encode().split()
                    total.append(len(words))
                    if spans:
                        depth = np.zeros(len(words) + 1, dtype=np.int64)
                        for s in spans:
                            depth[s["lo"]] += 1
                            depth[s["hi"]] -= 1
                        words = list(compress(words, (np.cumsum(depth[:-1]) == 0).tolist()))
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                cols = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("id"), *cols], ["id", "n_words", "n_removed", "kept"])

    return met.mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("id", id_col)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document, and the digest of the rest."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), pos AS (
  SELECT r, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13
), win AS (
  SELECT r, doc_id, i, array_to_string(words[i:i + 12], ' ') AS g FROM pos
), repeat AS (
  SELECT r, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY g) < coalesce(doc_id, 9223372036854775807)
), gone AS (
  SELECT r, list(DISTINCT j) AS js FROM (SELECT r, unnest(range(i, i + 13)) AS j FROM repeat) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN js IS NULL THEN array_to_string(words, ' ')
    ELSE coalesce(array_to_string(list_filter(words, lambda x, k: NOT list_contains(js, k)), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN gone USING (r)
"""

QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLE_SQL = {"op7_substring_dedup": _SQL}

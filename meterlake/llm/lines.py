"""Removal of lines that many documents share, by range-partitioned hashes.

1. Each line's key (stripped, A-Z lower-cased) of ``LEAST_CHARS`` characters or more goes on as a 128-bit hash with its document and
   place, texts stay behind. These rows are partitioned by ranges of (hash, document from the largest down, text, place) and
   sorted inside. As place is part of the range, a line that is everywhere lies in as many partitions as it needs.
2. A partition is read as a stream. A hash's first document is the one that keeps its lines; once the
   fifth document has been seen, all lines of later ones are dropped as they pass. What a stream holds of a hash
   is its first documents' rows, no more. Only the first and the last hash of a partition may go on in another one: their open rows and
   counts are passed on, and as these are two hashes a partition, sums over them are a small table.
3. Dropped places are gathered by document into a bitmap of the lines to keep, packed and compressed. The result is these
   bitmaps, for the documents that lose lines; all others keep all. ``apply_bitmaps`` brings them to the texts.

A bitmap belongs to an id and a text (its hash), so rows of one id with different texts have bitmaps of their own, and
equal rows share one.

Defined results: null text is read as empty, which is one empty line; rows with a null id are one document, smaller than any other; rows
that share an id are one document, so a line is kept in all of them or in none; ties cannot occur, as the
document that keeps a line is an id; an empty table gives no rows; ids must be integers; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.lookup import attach
from meterlake.llm.shared import materialize, text_of
from meterlake.llm.words import slices
from meterlake.sources.tables import table

LEAST_CHARS, LEAST_DOCS = 40, 5
STRIP = " \t\n\v\f\r"
_LINES = "h1 bigint, h2 bigint, doc bigint, tag bigint, pos bigint"
#: A null id, smaller than all others.
_FIRST = -(1 << 63)
#: Rows of the stream: a place to drop, a place whose hash is still open, the first document of a hash that is known to be common.
_DROP, _OPEN, _COMMON = 0, 1, 2


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[id_col].cast("bigint"), F.lit(_FIRST)).alias("doc"), text_of(docs[text_col]).alias("text"))
    return rows.withColumn("tag", F.xxhash64("text"))


def line_hashes(rows: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``h1``, ``h2``, ``doc``, ``tag``, ``pos`` of every line with a key of ``least_chars`` or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for part in slices(b):
                lists = pc.split_pattern(part.column("text"), "\n")
                size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                keys = pc.ascii_lower(pc.utf8_trim(lists.flatten(), characters=STRIP))
                row = np.repeat(np.arange(len(size)), size)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                long = pc.greater_equal(pc.utf8_length(keys), least_chars)
                at = np.flatnonzero(long.to_numpy(zero_copy_only=False))
                digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys.filter(long).to_pylist())), dtype=np.int64).reshape(-1, 2)
                doc, tag = (part.column(c).to_numpy()[row[at]] for c in ("doc", "tag"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (digest[:, 0].copy(), digest[:, 1].copy(), doc, tag, pos[at])], ["h1", "h2", "doc", "tag", "pos"])

    return rows.select("doc", "tag", "text").mapInArrow(scan, _LINES)


def _stream(least_docs: int):
    """Rows of one partition in the order of hash, document from the largest down, text and place, as they pass."""
    names = ["h1", "h2", "doc", "tag", "pos", "kind"]

    def out(cols: list[np.ndarray], rows: np.ndarray, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c[rows]) for c in cols), pa.array(np.full(int(np.count_nonzero(rows)), kind, dtype=np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the hash that the stream is in: its rows while it has few documents, its documents so far, the first and the last of them
        now, held, docs, top, last = None, [], 0, 0, 0
        begins = True  # is it the partition's first?
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in names[:5]]
            h1, h2, doc = cols[:3]
            starts = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(doc))))
            goes_on = now == (h1[0], h2[0])
            if now is not None and not goes_on:  # complete: what is still held has too few documents
                begins, held, docs = False, [], 0
            new = np.concatenate(([True], doc[1:] != doc[:-1]))
            new[starts] = True
            new[0] = not goes_on or doc[0] != last
            seen = np.cumsum(new)
            total = seen[np.append(starts[1:], len(seen)) - 1] - np.concatenate(([0], seen))[starts]
            first = doc[starts].copy()
            if goes_on:
                total[0] += docs
                first[0] = top
            common = total >= least_docs
            if begins:
                yield out(cols, group == 0, _OPEN)
            elif common[0]:
                for h in held:
                    yield out(h, h[2] != first[0], _DROP)
            gone = common[group] & (doc != first[group])
            if begins:
                gone &= group > 0
            if gone.any():
                yield out(cols, gone, _DROP)
            now, docs, top, last = (h1[-1], h2[-1]), int(total[-1]), first[-1], doc[-1]
            if len(starts) > 1:
                begins, held = False, []
            if begins or common[-1]:
                held = []
            else:
                held.append([c[starts[-1] :].copy() for c in cols])
        if now is None or begins:
            return
        if docs >= least_docs:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*now, top, 0, -1)), pa.array([_COMMON], pa.int32())], names)
        for h in held:
            yield out(h, np.ones(len(h[0]), dtype=bool), _OPEN)

    return run


def dropped_places(rows: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``doc``, ``tag``, ``pos`` of lines to drop; equal rows of the input give equal rows here."""
    lines = materialize(line_hashes(rows, least_chars), "lines")  # ranges are found by reading them once more
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("tag"), F.col("pos")]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    passed = materialize(dealt.mapInArrow(_stream(least_docs), f"{_LINES}, kind int"), "passed")
    open_ = passed.filter(F.col("kind") != _DROP)
    by_doc = open_.groupBy("h1", "h2", "doc").agg(F.max("kind").alias("kind"))
    known = by_doc.groupBy("h1", "h2").agg(F.count_if(F.col("kind") == _OPEN).alias("open"), F.max("kind").alias("kind"), F.max("doc").alias("top"))
    known = known.filter((F.col("open") >= least_docs) | (F.col("kind") == _COMMON)).select("h1", "h2", "top")  # two hashes a partition at most
    late = passed.filter(F.col("kind") == _OPEN).join(F.broadcast(known), ["h1", "h2"]).filter("doc < top")
    place = ["doc", "tag", "pos"]
    return passed.filter(F.col("kind") == _DROP).select(place).union(late.select(place))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blobs = []
        for places, n in zip(b.column("places"), b.column("n_lines").to_pylist()):
            keep = np.ones(-(-n // 8) * 8, dtype=bool)
            keep[places.values.to_numpy()] = False
            blobs.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tag"), pa.array(blobs, pa.binary())], ["doc", "tag", "bitmap"])


def kept_lines(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which lines a bitmap keeps; those after its last bit are kept too."""
    keep = np.ones(n_lines, dtype=bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))[:n_lines]
        keep[: len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``doc`` (the id; for null the smallest number), ``tag`` (xxhash64 of the text) and ``bitmap`` of documents that lose lines; read it with ``kept_lines``."""
    gone = dropped_places(_rows(docs, id_col, text_col), least_chars, least_docs)
    by_doc = gone.groupBy("doc", "tag").agg(F.collect_set("pos").alias("places"))
    # as many bits as reach the last dropped line: those after it are kept
    return by_doc.withColumn("n_lines", F.array_max("places") + 1).mapInArrow(_packed, "doc bigint, tag bigint, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_lines``, ``n_dropped``, and ``kept``, the lines that stay, joined by line breaks."""
    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    met = attach(rows, bitmaps, ["doc", "tag"]).select("id", "text", "bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                total, gone, kept = [], [], []
                for text, bitmap in zip(part.column("text").to_pylist(), part.column("bitmap").to_pylist()):
                    n = text.count("\n") + 1
                    keep = kept_lines(bitmap, n)
                    total.append(n), gone.append(n - int(keep.sum()))
                    kept.append("\n".join(compress(text.split("\n"), keep.tolist())) if gone[-1] else text)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_lines", "n_dropped", "kept"])

    return met.mapInArrow(run, f"id {kind}, n_lines bigint, n_dropped bigint, kept string").withColumnRenamed("id", id_col)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep_bitmaps`` and ``apply_bitmaps`` in one."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col), id_col, text_col)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from every document, and the digest of the rest."""
    found = drop_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d
), k AS (
  SELECT r, doc_id, i, line, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), common AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, common.key IS NOT NULL AND k.doc_id IS DISTINCT FROM common.top AS gone FROM k LEFT JOIN common USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""

QUERIES = {"op11_line_dedup": op11_line_dedup}
ORACLE_SQL = {"op11_line_dedup": _SQL}

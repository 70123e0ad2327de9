"""Packing: documents as token ids into windows of fixed length, online, by sum of squares.

Every partition packs the documents it reads, so nothing is shuffled and no key can
be hot. A document longer than a window first fills whole windows; its tail goes to
the fill level h that makes the sum over levels of (number of windows at that
level) squared smallest, looked up in a level array (ties: the fullest window).
Level 0 is a new window, and the rule is free to open one: how many may be open is bound by memory alone (``OPEN``, 4 KB each), and
only a tail for which the rule wants one more than that is cut: its beginning fills the window at the level that leaves the smallest sum, its
end opens the next. A window is written out as soon as it is full.

When a partition ends, windows filled to ``KEEP`` or more stay as the rule left them, and are padded. The others' pieces fill windows to
the brim, and the last, part-filled one is written as windows of powers of two, which need no padding. The share of tails that this
concerns falls with the documents of a partition.

``sequence_id`` holds the partition in its upper bits, so ids are unique over the
job without coordination.

Defined results: null text is read as empty; an empty text is its end id alone; a
null id stays null; repeated rows are packed each; an empty table gives no rows;
other columns are ignored. Memory holds ``OPEN`` windows and the document at hand.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.shared import text_of
from meterlake.sources.tables import table

WINDOW, END_ID, TOKENIZER = 1024, 0, "byte_bpe_50k"
#: Windows that a partition keeps open at most (40 MB), and how full one has to be to stay as it is at the end.
OPEN, KEEP = 10_000, 7 / 8
#: Texts read at a time.
ROWS = 500
#: Outside these characters the ``tokenizers`` library encodes; inside, ``tiktoken`` gives the same ids, three times as fast.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ]")


def encoder(name: str = TOKENIZER, folder: str | None = None) -> Callable[[str], np.ndarray]:
    """Text to token ids (uint32) of the vocabulary ``name``; strings of special tokens are ordinary text.

    ``folder`` holds ``name``.json and ``name``.tiktoken; by default the installed public vocabularies are used.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = lambda file: f"{folder}/{file}" if folder else public_tokenizers.path(file)
    with open(path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = Tokenizer.from_file(path(f"{name}.json"))
    full.encode_special_tokens = True

    def encode(text: str) -> np.ndarray:
        if not text.isascii() and _OTHER.search(text):
            return np.array(full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return quick.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    return encode


class Piece:
    """Ids [start, start + len(ids)) of document ``doc`` (a row of the partition)."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc: object, start: int, ids: np.ndarray, total: int) -> None:
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


class Levels:
    """Open windows by fill level, and the choice of a level for a new piece."""

    def __init__(self, window: int, most: int = OPEN) -> None:
        self.window, self.most = window, most
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)

    def level_for(self, size: int) -> int:
        """The level that keeps the sum of squared counts smallest; 0 is a new window."""
        at, after = self.count[1 : self.window - size + 1], self.count[size + 1 : self.window + 1]
        change = 2 * (after - at) + 2  # count[window] stays 0
        if len(change):
            change[-1] -= 1  # a window that becomes full leaves the levels
            change = np.where(at > 0, change, np.iinfo(np.int64).max)
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if at[best] and change[best] <= 2 * self.count[size] + 1:
                return best + 1
        return 0

    def level_within(self, size: int) -> int:
        """As ``level_for``, among open windows alone; a piece that a window has no room for leaves its rest in a new one."""
        at = self.count[1 : self.window]
        to = np.arange(1, self.window) + size
        after = self.count[np.where(to <= self.window, to, to - self.window)]
        change = 2 * (after - at) + 2 - (to == self.window)
        change = np.where(at > 0, change, np.iinfo(np.int64).max)
        return len(change) - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece of under one window; a window that it fills is returned."""
        level = self.level_for(len(piece.ids))
        if not level and self.count.sum() >= self.most:
            level = self.level_within(len(piece.ids))
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
        room, rest = self.window - level, None
        if len(piece.ids) > room:
            piece, rest = piece.cut(room)
        pieces.append(piece)
        level += len(piece.ids)
        if rest is not None:
            self._keep([rest], len(rest.ids))
        if level == self.window:
            return pieces
        self._keep(pieces, level)
        return None

    def _keep(self, pieces: list[Piece], level: int) -> None:
        self.open[level].append(pieces)
        self.count[level] += 1

    def rest(self, keep: float = KEEP) -> Iterator[list[Piece]]:
        """What is open: windows that are full enough, then the others cut anew to full ones and to powers of two."""
        for level in sorted(self.open, reverse=True):
            if level >= keep * self.window:
                yield from self.open.pop(level)
        left = [p for level in sorted(self.open, reverse=True) for pieces in self.open[level] for p in pieces]
        total = sum(len(p.ids) for p in left)
        left.reverse()
        while total:
            size = self.window if total >= self.window else 1 << (total.bit_length() - 1)
            total -= size
            pieces = []
            while size:
                p = left.pop()
                if len(p.ids) > size:
                    p, more = p.cut(size)
                    left.append(more)
                pieces.append(p)
                size -= len(p.ids)
            yield pieces


def windows_of(documents: Iterator[tuple[object, np.ndarray]], window: int, most: int = OPEN, keep: float = KEEP) -> Iterator[list[Piece]]:
    """Windows, each a list of pieces in order, of documents given as (id, token ids)."""
    levels = Levels(window, most)
    for doc, ids in documents:
        whole = len(ids) - len(ids) % window
        for start in range(0, whole, window):
            yield [Piece(doc, start, ids[start : start + window], len(ids))]
        if whole < len(ids) and (full := levels.place(Piece(doc, whole, ids[whole:].copy(), len(ids)))):
            yield full
    yield from levels.rest(keep)


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    open_windows: int = OPEN,
    keep: float = KEEP,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, folder)
        id_type: list[pa.DataType] = []

        def documents() -> Iterator[tuple[object, np.ndarray]]:
            for b in batches:
                id_type[:] = [b.schema.field("id").type]
                for k in range(0, b.num_rows, ROWS):
                    part = b.slice(k, ROWS)
                    for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                        yield doc, np.append(encode(text), np.uint32(end_id))

        names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            types = [id_type[0], pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return batch

        sequence = TaskContext.get().partitionId() << 36
        for pieces in windows_of(documents(), window, open_windows, keep):
            offset = 0
            for p in pieces:
                out.append((p.doc, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.total, sequence, offset))
                offset += len(p.ids)
            sequence += 1
            if len(out) >= 2000:
                yield flush()
        if out:
            yield flush()

    schema = f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of ``ids``."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_pack_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 ids."""
    return with_digest(pack(table(spark, sf_dir, "documents")))


QUERIES = {"op3_pack_sum_of_squares": op3_pack_sum_of_squares}
ORACLE_SQL: dict[str, str] = {}

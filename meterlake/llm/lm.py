"""Language-model scoring with a log-frequency Bloom filter.

Words, pairs and, where asked for, longer runs of words are counted over all training documents. A filter for each order
holds a count as levels, two for each doubling (1, 2, 3, 4, 6, 8, 12, ...): an n-gram is entered at every level that
its count reaches, and read by probing level after level until one is missing, as the count where the last one begins.
Filters are broadcast; their size follows the data up to ``FILTER_BITS``. Where that is too little, the lowest levels
are left out of the filter, and n-grams that are not found in it are joined with the table of those left out:
the way of reading changes with the size, the model (up to hashes that collide) does not.

The model interpolates its orders (here 3, 2 and 1, as in the query), with absolute discounting::

    p(w | u v) = max(q(u v w) - DISCOUNT, 0) / T(u v) + left(u v) * p(w | v)
    p(w | v)   = max(q(v w) - DISCOUNT, 0) / T(v) + left(v) * p(w)
    p(w)       = (c(w) + 0.1) / (N + 0.1 * (V + 1))                            c(w) exact

q is the count as the filter has it, T(c) the number of tokens seen in context c, which is the exact count of the words c. left(c) is made of the levels
as they were entered, so it is never below zero and makes the sum over all words one, but for what probes find by mistake. T and left of each order's most frequent contexts (``CONTEXTS``) are broadcast; the filter
says which others have stored n-grams at all, and tokens in those are joined with their T and left (in all others left is 1). N-grams seen once are left to the
shorter context, at every size. A triple is counted only if its first two words were seen
together twice or more, and its last two, which no repeated triple fails. One absent n-gram in 10 ** 6 is found by mistake (``PROBES``),
and one stored n-gram in 4,000 is read a level too high (``HIGHER_PROBES``).

The base score is the sum of log10 p(w). Counts of words are exact: the most frequent (``HEAD``) are broadcast, all others
are joined on the word, for both scores at once.

There are two ways to the same scores. ``train`` and ``score`` make a model that is at hand in every task and scores any texts; it suits small ones. ``scored``, which the query
uses, makes and reads the filter in pieces, in tasks that the texts' n-grams are sent to: nothing of the model is at hand anywhere, and no token is joined by itself.

Words are runs outside ASCII white space, A-Z lower-cased, then one end mark, which is also what stands before a
text; the first word of a text has no context of two. Rows whose crc32 of the id as text is 0 modulo ``FOLDS`` are held out from training. Words are identified by
62 bits of their hashes, contexts and followers by 48 bits, n-grams by 62 bits of theirs: no table of fixed size stands between a context and its counts.

Defined results: null text is read as empty (its end mark is still a token); with no
training rows N and V are 0, and every token has probability 1; a null id counts
as empty text for the held-out rule and stays null; repeated rows count and are scored
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.bitmap import bits_for, build, contains, entered
from meterlake.llm.shared import materialize, remainder, text_of
from meterlake.llm.words import BASE, mixed, slices
from meterlake.sources.tables import table

FOLDS, ALPHA, DISCOUNT = 10, 0.1, 0.75
#: Lengths of n-grams: of a model for which none are asked for, and of the query's.
ORDERS, QUERY_ORDERS = (2,), (2, 3)
HEAD = 1 << 18
#: Contexts of each order whose numbers are broadcast, at most.
CONTEXTS = 1 << 21
#: Bits of a filter at most; probes and bits of an n-gram's first level, which tells it from those never seen, and of each higher one.
FILTER_BITS = 5 << 27
PROBES, BITS_EACH, HIGHER_PROBES, HIGHER_BITS = 20, 29, 12, 18
#: Probes of what tells contexts with n-grams.
FLAG_PROBES = 8
#: Least level that is stored (2: seen twice).
LEAST = 2
#: Tokens that a task counts before it passes the counts on, characters of text whose n-grams meet in one part, and of a slice.
FLUSH, PART_CHARS, SLICE = 1 << 20, 1 << 23, 1 << 19
#: Rows that Python takes at a time, and of runs of texts, which are some MB each.
BATCH, RUNS = 1000, 16
#: Tokens whose n-grams meet in one part, so many at least where there are up to ``FEW`` parts, so many beyond that: a run sends a row to each part, so parts are not many.
LESS, FEW, PART = 1 << 18, 64, 1 << 23
#: N-grams that a part takes at a time, and contexts whose n-grams are dealt to all parts, at most.
PIECE, HOT = 1 << 19, 1 << 14
#: Parts up to which a context's followers meet in one; with every so many more, in one more.
SPREAD = 128
#: Places of two numbers in one.
_HALF, _LOW = np.uint64(32), np.uint64((1 << 32) - 1)
_END = np.uint64(0x5851F42D4C957F2D)


#: Bytes that are white space, lower case of bytes, and a random 64-bit number for each byte.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NUMBER = np.random.default_rng(6).integers(0, 1 << 64, 256, dtype=np.uint64)
_NUMBER[ord("A") : ord("Z") + 1] = _NUMBER[ord("a") : ord("z") + 1]
_NUMBER[_SPACE] = 0
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@lru_cache(maxsize=2)
def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass(frozen=True)
class Tokens:
    """Hashes of the tokens of several texts (each with its end mark), and the texts' offsets in them."""

    words: np.ndarray
    offsets: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    """A word's hash is the sum of its bytes' numbers, each times a power of ``BASE`` by its place, mixed."""
    wide = texts.cast(pa.large_string())
    at = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(wide.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    blank = _SPACE[raw]
    first = ~blank
    first[1:] &= blank[:-1]
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    first[inner] = ~blank[inner]  # a word ends with its text
    starts = np.flatnonzero(first)
    hashes = np.zeros(0, dtype=np.uint64)
    if len(starts):
        of = _powers if len(raw) <= SLICE else _powers.__wrapped__  # those of a long text are not kept
        powers, inverse = (of(b, max(len(raw), SLICE)) for b in (BASE, _INVERSE))
        value = _NUMBER[raw]
        value *= powers[: len(raw)]
        np.cumsum(value, out=value)
        until = np.append(value[starts - 1], value[-1])
        until[0] = 0  # what stands before the first word is blank
        hashes = mixed(mixed(np.diff(until) * inverse[starts]))
    ends = np.searchsorted(starts, at[1:]) + np.arange(len(texts))
    words = np.full(len(hashes) + len(texts), _END, dtype=np.uint64)
    is_word = np.ones(len(words), dtype=bool)
    is_word[ends] = False
    words[is_word] = hashes
    return Tokens(words, np.concatenate(([0], ends + 1)))


#: Kinds of keys, in their two lowest bits: a word, an n-gram, a context that has stored n-grams.
_WORD, _GRAM, _FLAG = np.uint64(0), np.uint64(1), np.uint64(2)
_KIND = np.uint64(3)
#: A context is named by the upper 48 bits of the key of its words, a follower by as many of its own.
_CUT = np.uint64(16)


def word_keys(words: np.ndarray) -> np.ndarray:
    return words & ~_KIND


def _gram_keys(context: np.ndarray, follower: np.ndarray) -> np.ndarray:
    return mixed(mixed(context * BASE + follower)) & ~_KIND | _GRAM


def flag_keys(context: np.ndarray) -> np.ndarray:
    return mixed(context) & ~_KIND | _FLAG


def coded(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of words, sorted, and each token's place among them."""
    return _different(word_keys(t.words))


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with the inverse. Numbers are sorted with their places in their lowest bits, several times as fast as places by numbers; what that leaves unsorted is sorted anew."""
    places = np.uint64(len(keys).bit_length())
    lowest = (np.uint64(1) << places) - np.uint64(1)
    free = np.uint64(64 - int(keys.max(initial=0)).bit_length())  # bits above all keys
    order = (np.sort((keys << free) & ~lowest | np.arange(len(keys), dtype=np.uint64)) & lowest).astype(np.int64)
    rows = keys[order]
    if (rows[1:] < rows[:-1]).any():
        order = np.argsort(keys)
        rows = keys[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = rows[1:] != rows[:-1]
    back = np.empty(len(rows), dtype=np.int32 if len(rows) < 1 << 31 else np.int64)
    back[order] = np.cumsum(new) - 1
    return rows[new], back


def _shifted(ids: np.ndarray, offsets: np.ndarray, first: int) -> np.ndarray:
    """What stands one token before; ``first`` where a text begins."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[offsets[:-1]] = first
    return out


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << _HALF | b.astype(np.uint64)


def _grams(contexts: np.ndarray, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams (as of ``_both``) and each token's place among them, from places in the keys of contexts and of words, of which there are ``most``."""
    bits = np.uint64(int(most).bit_length())
    found, back = _different(contexts.astype(np.uint64) << bits | words.astype(np.uint64))
    return found >> bits << _HALF | found & ((np.uint64(1) << bits) - np.uint64(1)), back


def _keys_of(grams: np.ndarray, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of n-grams, given as places (``_both``) in the keys of contexts and of words."""
    return _gram_keys(contexts[grams >> _HALF] >> _CUT, words[grams & _LOW] >> _CUT)


def _short(x: np.ndarray) -> bytes:
    """Numbers of 48 bits in 6 bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _small(n: np.ndarray, wide: str = "<u4") -> bytes:
    """Counts in a byte each; those of 255 or more follow in four (or as ``wide``)."""
    big = n > 254
    return np.where(big, 255, n).astype(np.uint8).tobytes() + n[big].astype(wide).tobytes()


def _counts(raw: bytes, k: int, wide: str = "<u4") -> np.ndarray:
    n = np.frombuffer(raw, dtype=np.uint8, count=k).astype(np.int64)
    n[n == 255] = np.frombuffer(raw, dtype=wide, offset=k)
    return n


def _counted(rows: DataFrame, order: int, gate: Broadcast | None, parts: int) -> DataFrame:
    """Counts of all n-grams of ``order`` (``key``, ``n``) seen ``LEAST`` times or more, and of their contexts (``key``, ``n``, ``total``, ``mass``).

    ``total`` and ``mass`` (what n-grams of the context hold) are null for n-grams; contexts of two words or more come only if they may have n-grams. ``gate``:
    the filter of the order below: an n-gram is counted only if its first words and its last ones are in it. Where that holds a null, all are.

    A task sums before it passes runs on, one for each part, in which a context stands once before its followers. Past ``SPREAD`` parts a context's followers
    are dealt to several, so that no frequent context gathers them in one place; its rows are then to be summed (``_contexts``).
    """
    spread = 1 + parts // SPREAD

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(t.words) for t in held)])
            t = Tokens(np.concatenate([t.words for t in held]), np.concatenate([*(t.offsets[:-1] + e for t, e in zip(held, ends)), ends[-1:]]))
            held.clear()
            words, code = coded(t)
            keys, ids, whole = words, code, np.ones(len(code), dtype=bool)
            for k in range(2, order):
                back, whole = _shifted(ids, t.offsets, np.searchsorted(words, word_keys(_END)) if k == 2 else 0), _shifted(whole, t.offsets, k == 2)
                grams, ids = _grams(back, code, len(words))
                keys = _keys_of(grams, keys, words)
            back, counted = _shifted(ids, t.offsets, np.searchsorted(words, word_keys(_END)) if order == 2 else 0), _shifted(whole, t.offsets, order == 2)
            kept = counted
            if gate is not None and gate.value is not None:
                stored = contains(gate.value, keys, LEAST, PROBES)
                counted = counted & stored[back]
                kept = counted & stored[ids]
            total = np.bincount(back[counted], minlength=len(keys))
            own = np.flatnonzero(total)  # a context's total stands as one more follower, behind all others
            grams, n = np.unique(np.concatenate([_both(back[kept], code[kept]), _both(own, np.full(len(own), _LOW))]), return_counts=True)
            del back, ids, counted, kept, code, whole
            context, follower = (grams >> _HALF).astype(np.int64), grams & _LOW
            last = follower == _LOW
            n[last] = total[context[last]]
            follower = words[np.where(last, 0, follower)] >> _CUT
            part = (mixed(keys >> _CUT) >> np.uint64(20))[context]
            if spread > 1:
                part += np.where(last, 0, follower >> np.uint64(8)) % np.uint64(spread)
            part = (part % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
            by = np.argsort(part, kind="stable")
            part, context, follower, last, n = part[by], context[by], follower[by], last[by], n[by]
            begin = np.flatnonzero(np.diff(part, prepend=part[:1] + 1).astype(bool) | np.diff(context, prepend=-1).astype(bool))
            totals, sizes = (np.add.reduceat(x, begin) if len(begin) else x for x in (np.where(last, n, 0), (~last).astype(np.int64)))
            keys, follower, n = keys[context[begin]], follower[~last], n[~last]
            own, inner = part[begin], part[~last]
            out = []
            for i in np.unique(own).tolist():
                some, those = (slice(*np.searchsorted(x, [i, i + 1])) for x in (own, inner))
                out.append((i, keys[some].tobytes() if order == 2 else _short(keys[some] >> _CUT), _small(totals[some]), _small(sizes[some]), _short(follower[those]), _small(n[those])))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] + [pa.binary()] * 5)], ["part", *"abcde"]) if out else None

        for b in batches:
            for piece in slices(b, most=SLICE):
                held.append(tokens(piece.column("text")))
                size += len(held[-1].words)
                if size > FLUSH:
                    if (found := flush()) is not None:
                        yield found
                    size = 0
        if held and (found := flush()) is not None:
            yield found

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            key, totals, context, follower, n = map(np.concatenate, zip(*held))
            held.clear()
            gram, back = _different(_gram_keys(context >> _CUT, follower))
            n = np.bincount(back, weights=n, minlength=len(gram)).astype(np.int64)
            at = np.empty(len(gram), dtype=np.int64)
            at[back] = np.arange(len(back))
            kept = n >= LEAST
            gram, n, context = gram[kept], n[kept], context[at[kept]] >> _CUT
            key, back = _different(key)
            own = np.bincount(back, weights=totals, minlength=len(key))
            different, first, back = np.unique(key >> _CUT, return_index=True, return_inverse=True)
            all_ = np.bincount(back, weights=own, minlength=len(different))
            mass = np.bincount(np.searchsorted(different, context), weights=level_value(level_of(n)) - DISCOUNT, minlength=len(different))
            one = np.zeros(len(key), dtype=bool)  # two words may share the name of a context
            one[first] = True
            shown = np.ones(len(key), dtype=bool) if order == 2 or spread > 1 else one & (mass[back] > 0)
            totals = pa.array(np.concatenate([all_[back][shown], np.zeros(len(gram))]).astype(np.int64), mask=np.concatenate([~one[shown], np.ones(len(gram), dtype=bool)]))
            masses = pa.array(np.concatenate([mass[back][shown], np.zeros(len(gram))]), mask=np.concatenate([~one[shown], np.ones(len(gram), dtype=bool)]))
            is_gram = pa.array(np.concatenate([np.zeros(shown.sum(), dtype=bool), np.ones(len(gram), dtype=bool)]))
            keys, counts = np.concatenate([key[shown], gram]).view(np.int64), np.concatenate([own[shown].astype(np.int64), n])
            return pa.RecordBatch.from_arrays([is_gram, pa.array(keys), pa.array(counts), totals, masses], ["gram", "key", "n", "total", "mass"])

        for batch in batches:
            for part, a, b, c, d, e in zip(*(batch.column(x).to_pylist() for x in ("part", *"abcde"))):
                if part != now and held:
                    yield close()
                now = part
                key, follower = np.frombuffer(a, dtype=np.uint64) if order == 2 else _long(a) << _CUT, _long(d)
                held.append((key, _counts(b, len(key)), np.repeat(key, _counts(c, len(key))), follower, _counts(e, len(follower))))
        if held:
            yield close()

    dealt = rows.mapInArrow(scan, "part bigint, a binary, b binary, c binary, d binary, e binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(total, "gram boolean, key bigint, n bigint, total bigint, mass double")


@contextmanager
def _tidy(spark: SparkSession, batch: int | None = None) -> Iterator[None]:
    """What an action shuffles is deleted at its end, not when the driver happens to collect its garbage, and Python takes ``BATCH`` rows at a time; ``batch``: so many, also from files."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch or BATCH)}
    if batch:
        wanted["spark.sql.parquet.columnarReaderBatchSize"] = str(batch)
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _kept(rows: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    with _tidy(rows.sparkSession, batch):
        return materialize(rows, name)


def _words(found: DataFrame, parts: int) -> DataFrame:
    """Exact counts of words (``key``, ``n``), of the counts of pairs."""
    counts = found.filter("NOT gram").select("key", "n")
    return counts if parts < SPREAD else _kept(counts.groupBy("key").agg(F.sum("n").alias("n")), "words")


def _contexts(found: DataFrame, parts: int) -> DataFrame:
    """Contexts with stored n-grams: ``context``, ``total`` and ``mass``."""
    rows = found.filter("total IS NOT NULL").select(F.shiftrightunsigned("key", int(_CUT)).alias("context"), "total", "mass")
    if parts < SPREAD:
        return rows.filter("mass > 0")
    return _kept(rows.groupBy("context").agg(F.sum("total").alias("total"), F.sum("mass").alias("mass")).filter("mass > 0"), "contexts")


def _find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key (any, if it has none), and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return at, sorted_[at] == keys


@dataclass(frozen=True)
class Vocabulary:
    """The most frequent words: sorted keys and their counts."""

    hashes: np.ndarray
    counts: np.ndarray


@dataclass(frozen=True)
class Contexts:
    """The most frequent contexts with stored n-grams: sorted names, tokens seen in them, what their n-grams hold; are these all?"""

    keys: np.ndarray
    totals: np.ndarray
    mass: np.ndarray
    whole: bool


def _frequent(rows: DataFrame, n: str, most: int) -> tuple[pa.Table, int]:
    """Rows as frequent as the least ``n`` that ``most`` rows or fewer reach, and the number of all; others are joined, so where the line runs changes no result."""
    levels = rows.groupBy(n).count().toArrow()  # one row for each different count
    values, count = levels.column(n).to_numpy(), levels.column("count").to_numpy()
    order = np.argsort(-values)
    fit = np.cumsum(count[order]) <= most
    cut = int(values[order][fit][-1]) if fit.any() else None
    return (rows.filter(F.col(n) >= cut) if cut is not None else rows.limit(0)).toArrow(), int(count.sum())


def vocabulary(counts: DataFrame, most: int = HEAD) -> Vocabulary:
    head, _ = _frequent(counts, "n", most)
    hashes, n = head.column("key").to_numpy().view(np.uint64), head.column("n").to_numpy()
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], n[order])


def _narrow(x: np.ndarray, kind: type) -> np.ndarray:
    """As ``kind``, if that changes no value."""
    return y if (y := x.astype(kind)).astype(x.dtype).tobytes() == x.tobytes() else x


def frequent_contexts(contexts: DataFrame, most: int) -> tuple[Contexts, int]:
    """The contexts that are broadcast, and the number of all."""
    head, count = _frequent(contexts, "total", most)
    keys = head.column("context").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    total, mass = _narrow(head.column("total").to_numpy(), np.uint32), _narrow(head.column("mass").to_numpy(), np.float32)
    near = Contexts(keys[order], total[order], mass[order], len(keys) == count)
    del head, keys
    pa.default_memory_pool().release_unused()
    return near, count


def level_value(level: np.ndarray) -> np.ndarray:
    """The least count of a level: 0, 1, 2, 3, 4, 6, 8, 12, ..."""
    level = np.asarray(level, dtype=np.int64)
    half = np.maximum(level // 2, 1)
    return np.where(level < 2, level, np.where(level % 2 == 0, 1 << half, 3 << half - 1))


_VALUES = level_value(np.arange(1, 126))


def level_of(n: np.ndarray) -> np.ndarray:
    """The highest level that a count of one or more reaches."""
    return np.searchsorted(_VALUES, n, side="right")


def _level(n: Column) -> Column:
    """``level_of`` for a column."""
    b = F.length(F.bin(n)).cast("int") - 1
    return F.when(n < 2, n.cast("int")).otherwise(2 * b + (n >= 1.5 * F.pow(F.lit(2.0), b)).cast("int"))


def log_frequency(bitmap: np.ndarray, keys: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Counts read from the filter: the least count of the highest level reached in unbroken probes from ``least``, else 0."""
    level = np.zeros(len(keys), dtype=np.int64)
    alive, at = np.arange(len(keys)), least
    while len(alive) and at < 126:
        alive = alive[contains(bitmap, keys[alive], at, PROBES if at == least else HIGHER_PROBES)]
        level[alive] = at
        at += 1
    return level_value(level)


@dataclass(frozen=True)
class Order:
    """N-grams of one length: filter, the least level in it, the contexts that are at hand; does the filter tell which others have n-grams?"""

    bitmap: np.ndarray
    least: int
    contexts: Contexts
    flags: bool


def _values(level: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(x)) for x in _VALUES)), level)


def order_of(found: DataFrame, parts: int, filter_bits: int) -> tuple[Order, DataFrame, DataFrame]:
    """The order whose counts (as of ``_counted``) are ``found``; its contexts (``context``, ``total``, ``left``); and the n-grams that its filter leaves out (``key``, ``q``)."""
    stored = found.filter("gram").select("key", _level(F.col("n")).alias("level"))
    contexts = _contexts(found, parts)
    near, marks = frequent_contexts(contexts, CONTEXTS)
    marks -= len(near.keys)
    held = {r[0]: r[1] for r in stored.groupBy("level").count().collect()}  # one row a level
    flags = 0 < BITS_EACH * marks * 2 <= filter_bits
    above = lambda low: sum(k * max(0, level - low + 1) for level, k in held.items())
    needed = lambda low: BITS_EACH * (above(low) - above(low + 1) + flags * marks) + HIGHER_BITS * above(low + 1)
    least = LEAST
    while needed(least) > filter_bits and above(least):
        least += 1
    keys = stored.filter(F.col("level") >= least).select("key", F.lit(least).alias("lo"), F.col("level").alias("hi"))
    if flags:
        cut = int(near.totals.min()) if len(near.keys) else None
        flagged = (contexts if cut is None else contexts.filter(F.col("total") < cut)).select("context").mapInArrow(_flagged, "key bigint")
        keys = keys.union(flagged.select("key", F.lit(1).alias("lo"), F.lit(1).alias("hi")))
    with _tidy(found.sparkSession):
        bitmap = build(keys, bits_for(needed(least), filter_bits, 1), PROBES, HIGHER_PROBES)
    left = contexts.select("context", "total", (1 - F.col("mass") / F.col("total")).alias("left"))
    return Order(bitmap, least, near, flags), left, stored.filter(F.col("level") < least).select("key", _values(F.col("level")).alias("q"))


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(flag_keys(b.column("context").to_numpy().view(np.uint64)).view(np.int64))], ["key"])


@dataclass(frozen=True)
class Model:
    words: Vocabulary
    orders: dict[int, Order]
    n: int
    v: int

    @property
    def whole(self) -> float:
        return self.n + ALPHA * (self.v + 1)

    def parts(self, t: Tokens, words: np.ndarray | None = None, code: np.ndarray | None = None) -> dict[int, dict[str, np.ndarray]]:
        """By order and token: ``part`` and ``left``, so that p = part + left * (p of the order below), where the context's numbers are at hand.

        Elsewhere ``context`` is not 0, and ``part`` is still to be divided by its total. ``gram`` is not 0 where the n-gram may be one that the filter leaves out;
        ``share`` is what its count is then multiplied by. ``words`` and ``code``: as of ``coded``, where they are known.
        """
        if words is None:
            words, code = coded(t)
        size = len(code)
        keys, ids, whole = words, code, np.ones(size, dtype=bool)
        out = {}
        for order in range(2, max(self.orders, default=1) + 1):
            back, whole = _shifted(ids, t.offsets, np.searchsorted(words, word_keys(_END)) if order == 2 else 0), _shifted(whole, t.offsets, order == 2)
            o, named = self.orders.get(order), keys >> _CUT
            if o is None:  # asked for longer n-grams only
                asked = np.flatnonzero(whole)
            else:
                place, near = _find(o.contexts.keys, named)
                has = near.copy()
                if not o.contexts.whole:
                    far = np.flatnonzero(~near)
                    has[far] = contains(o.bitmap, flag_keys(named[far]), 1, FLAG_PROBES) if o.flags else True  # one that is taken for one with n-grams by mistake costs a look, no more
                asked = np.flatnonzero(whole & has[back])  # in other contexts no n-gram is stored, so what a probe would find there is a mistake
            grams, at = _grams(back[asked], code[asked], len(words))
            grams = _keys_of(grams, keys, words)
            ids, whole = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool)
            ids[asked], whole[asked], keys = at, True, grams
            if o is None:
                continue
            q, share, left = np.zeros(size), np.ones(size), np.ones(size)
            q[asked] = log_frequency(o.bitmap, grams, o.least)[at]
            known = asked[near[back[asked]]]
            spot = place[back[known]]
            share[known] /= o.contexts.totals[spot]
            left[known] -= o.contexts.mass[spot] * share[known]
            far, gram = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)
            some = asked[~near[back[asked]]]
            far[some] = named[back[some]]
            if o.least > LEAST:
                gram[asked] = np.where(q[asked] == 0, grams[at], 0)
            else:
                whole &= q > 0  # an n-gram that is not stored is no context of longer ones
            out[order] = {"part": np.maximum(q - DISCOUNT, 0) * share, "share": share, "left": left, "context": far, "gram": gram}
        return out


def train(rows: DataFrame, filter_bits: int = FILTER_BITS, lengths: Sequence[int] = ORDERS) -> tuple[Model, DataFrame, dict[int, tuple[DataFrame, DataFrame]]]:
    """The model of the texts of ``rows``, the exact counts of all their words (``key``, ``n``), and by order its contexts and the n-grams beyond its filter."""
    chars = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    parts = 1 + chars // PART_CHARS
    found = _kept(_counted(rows, 2, None, parts), "words-and-pairs")
    counts = _words(found, parts)
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    orders, tables = {}, {}
    for order in lengths:
        if order > 2:
            before = orders.get(order - 1)
            gate = before.bitmap if before and before.least == LEAST else None  # a filter that leaves n-grams out says nothing about longer ones
            shared = rows.sparkSession.sparkContext.broadcast(gate)
            found = _kept(_counted(rows, order, shared, parts), f"{order}-grams")
            shared.destroy()
        orders[order], *tables[order] = order_of(found, parts, filter_bits)
    return Model(vocabulary(counts), orders, n, v), counts, tables


def score(docs: DataFrame, model: Model, counts: DataFrame, tables: dict[int, tuple[DataFrame, DataFrame]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``n_known``, ``base_score`` and ``score``.

    Tokens are scored where they are read, but for those that need a table: rare words, rare contexts with stored n-grams, and n-grams beyond a filter.
    """
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    orders = sorted(model.orders)
    joined = [k for k in orders if not model.orders[k].contexts.whole or model.orders[k].least > LEAST]
    fields = {"key": "bigint", "single": "double"}
    for k in orders:  # orders that are at hand are put together: p = a + b * (p of the order below)
        if k not in joined:
            up = next((j for j in joined if j > k), "")
            fields |= {f"a{up}": "double", f"b{up}": "double"}
            continue
        fields |= {f"part{k}": "double", f"left{k}": "double", f"context{k}": "bigint"} | ({f"gram{k}": "bigint", f"share{k}": "double"} if model.orders[k].least > LEAST else {})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        at = TaskContext.get().partitionId() << 36
        number = lambda x: pa.array(x.astype(np.uint64).view(np.int64), mask=x == 0)
        for batch in batches:
            for piece in slices(batch, most=SLICE):
                t = tokens(piece.column("text"))
                k, sizes = len(t.offsets) - 1, np.diff(t.offsets)
                text = np.repeat(np.arange(k), sizes)
                different, code = coded(t)
                place, inside = _find(m.words.hashes, different)
                exact = np.where(inside, m.words.counts[place], 0) if len(m.words.counts) else np.zeros(len(different))
                head, single = inside[code], ((exact + ALPHA) / m.whole)[code]
                base = np.where(head, np.log10(single), 0.0)
                p, open_, values = single, ~head, {}
                a, b = np.zeros(len(text)), np.ones(len(text))
                for order, found in sorted(m.parts(t, different, code).items()):
                    p = found["part"] + found["left"] * p
                    if order in joined:
                        open_ = open_ | (found["context"] > 0) | (found["gram"] > 0)
                        values |= {f"{c}{order}": x for c, x in (found | {"a": a, "b": b}).items()}
                        a, b = np.zeros(len(text)), np.ones(len(text))
                    else:
                        a, b = found["part"] + found["left"] * a, found["left"] * b
                values |= {"a": a, "b": b}
                log_p = np.zeros(len(text))
                log_p[~open_] = np.log10(np.minimum(p[~open_], 1.0))
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(text[open_], minlength=k)))).astype(np.int32))
                cols = {"key": pa.array(different[code[open_]].view(np.int64), mask=head[open_]), "single": pa.array(single[open_])}
                cols |= {c: number(values[c][open_]) if kind_ == "bigint" else pa.array(values[c][open_]) for c, kind_ in list(fields.items())[2:]}
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([cols[c] for c in fields], list(fields)))
                sums = [pa.array(np.bincount(text, weights=x, minlength=k)) for x in (base, log_p)]
                known = pa.array(np.bincount(text, weights=head, minlength=k).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at + np.arange(k)), piece.column("id"), pa.array(sizes), known, *sums, lists],
                    ["row", "id", "n_tokens", "known", "base", "score", "open"],
                )
                at += k

    opened = ", ".join(f"{name}: {type_}" for name, type_ in fields.items())
    schema = f"row bigint, id {kind}, n_tokens bigint, known bigint, base double, score double, open array<struct<{opened}>>"
    scanned = _kept(rows.mapInArrow(scan, schema), "scores")
    left = scanned.select("row", F.explode("open").alias("x")).select("row", "x.*")
    left = _looked_up(left, "key", counts.select("key", "n"), ["n"])
    for k in joined:
        contexts, beyond = tables[k]
        if f"gram{k}" in fields:
            left = _looked_up(left, f"gram{k}", beyond.select(F.col("key").alias(f"gram{k}"), F.col("q").alias(f"q{k}")), [f"q{k}"])
        names = {"context": f"context{k}", "total": f"total{k}", "left": f"more{k}"}
        left = _looked_up(left, f"context{k}", contexts.withColumnsRenamed(names), [f"total{k}", f"more{k}"])
    rare = F.col("key").isNotNull()
    single = F.when(rare, (F.coalesce("n", F.lit(0)) + ALPHA) / F.lit(model.whole)).otherwise(F.col("single"))
    p = single
    over = lambda k, p: F.col(f"a{k}") + F.col(f"b{k}") * p if f"a{k}" in fields else p
    for k in joined:
        p = over(k, p)
        part = F.col(f"part{k}")
        if f"gram{k}" in fields:
            part = part + F.greatest(F.coalesce(F.col(f"q{k}"), F.lit(0.0)) - DISCOUNT, F.lit(0.0)) * F.col(f"share{k}")
        p = part / F.coalesce(F.col(f"total{k}"), F.lit(1)) + F.coalesce(F.col(f"more{k}"), F.col(f"left{k}")) * p
    p = over("", p)
    found = left.groupBy("row").agg(
        F.count_if(rare & (F.col("n") > 0)).alias("more"),
        F.sum(F.when(rare, F.log10(single)).otherwise(0.0)).alias("rest"),
        F.sum(F.log10(F.least(p, F.lit(1.0)))).alias("scored"),
    )
    met = scanned.drop("open").join(found, "row", "left")
    return met.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("scored", F.lit(0.0))).alias("score"),
    )


def _looked_up(rows: DataFrame, key: str, table: DataFrame, names: Sequence[str]) -> DataFrame:
    """``rows`` with the columns ``names`` of ``table``. Rows without a key pass by: they are not part of the join, and not shuffled for it."""
    none = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in names]
    met = rows.filter(F.col(key).isNotNull()).join(table.select(key, *names), key, "left")
    return met.unionByName(rows.filter(F.col(key).isNull()).select("*", *none))


@dataclass(frozen=True)
class Run:
    """Texts that ask together: different words (keys, the most frequent first), each token's place among them, the texts' offsets, and which texts are learned from."""

    words: np.ndarray
    code: np.ndarray
    offsets: np.ndarray
    training: np.ndarray

    @property
    def learned(self) -> np.ndarray:
        return np.repeat(self.training, np.diff(self.offsets))


def _run_of(held: Sequence[tuple[Tokens, np.ndarray]]) -> Run:
    words, code = _different(word_keys(np.concatenate([t.words for t, _ in held])))
    by = np.argsort(-np.bincount(code), kind="stable")
    rank = np.empty(len(by), dtype=np.int64)
    rank[by] = np.arange(len(by))
    sizes = np.concatenate([np.diff(t.offsets) for t, _ in held])
    return Run(words[by], rank[code], np.concatenate(([0], np.cumsum(sizes))), np.concatenate([x for _, x in held]))


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _loose(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """Numbers of so many bytes, byte by byte, so that the many small ones take little."""
    return _squeezed(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def _numbers(raw: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(_loose(raw), dtype=np.uint8).reshape(width, -1)
    out = np.zeros(planes.shape[1], dtype=np.uint64)
    for i in range(width):
        out |= planes[i].astype(np.uint64) << np.uint64(8 * i)
    return out


def _width(n: int) -> int:
    """Bytes of numbers below ``n``."""
    return max(1, -(-(int(n) - 1).bit_length() // 8))


def _packed(run: Run) -> tuple[bytes, ...]:
    """Sizes, marks, differences of words (those of one frequency are sorted), and places."""
    return _planes(np.diff(run.offsets)), run.training.tobytes(), _planes(np.diff(run.words, prepend=np.uint64(0))), _planes(run.code, _width(len(run.words)))


def _unpacked(sizes: bytes, training: bytes, words: bytes, code: bytes) -> Run:
    words = np.cumsum(_numbers(words), dtype=np.uint64)
    offsets = np.concatenate(([0], np.cumsum(_numbers(sizes).astype(np.int64))))
    return Run(words, _numbers(code, _width(len(words))).astype(np.int64), offsets, np.frombuffer(training, dtype=bool))


@dataclass(frozen=True)
class Asked:
    """What a run asks the parts for, in the order in which it goes there and answers come back.

    ``at``: each token's n-gram (-1: none); ``by`` and ``part``: n-grams by part; ``own``, ``place`` and ``size``: part of each stretch of n-grams of one context, that context, and the stretch's length.
    """

    context: np.ndarray
    word: np.ndarray
    follower: np.ndarray
    at: np.ndarray
    hot: np.ndarray
    by: np.ndarray
    part: np.ndarray
    own: np.ndarray
    place: np.ndarray
    size: np.ndarray


def _asked(names: np.ndarray, followers: np.ndarray, back: np.ndarray, code: np.ndarray, kept: np.ndarray, hot: np.ndarray, alone: np.ndarray, parts: int) -> Asked:
    """``names`` and ``followers``: of contexts and words, 48 bits; ``back`` and ``code``: each token's places in them; ``kept``: tokens whose n-grams are asked for.

    A context goes to a part by its name, a ``hot`` one's n-grams are dealt by their followers; contexts marked ``alone`` are asked for even if no n-gram of theirs is.
    """
    many = np.uint64(parts)
    grams, found = _grams(back[kept], code[kept], max(len(names), len(followers)))
    at = np.full(len(code), -1, dtype=np.int64)
    at[kept] = found
    context, word = (grams >> _HALF).astype(np.int64), (grams & _LOW).astype(np.int64)
    follower = followers[word]
    home = (mixed(names) >> np.uint64(20)) % many
    part = np.where(hot[context], (mixed(mixed(names[context] * BASE + follower)) >> np.uint64(20)) % many, home[context]).astype(np.uint16 if parts < 1 << 16 else np.uint32)
    by = np.argsort(part, kind="stable")
    part = part[by]
    begin = np.flatnonzero(np.diff(part, prepend=part[:1] + 1).astype(bool) | np.diff(context[by], prepend=-1).astype(bool))
    own, place, size = part[begin], context[by][begin], np.diff(begin, append=len(by))
    with_none = alone & ~hot
    with_none[context] = False
    if with_none.any():
        more = np.flatnonzero(with_none)
        own, place, size = (np.concatenate(x) for x in ((own, home[more].astype(own.dtype)), (place, more), (size, np.zeros(len(more), dtype=size.dtype))))
        order = np.argsort(own.astype(np.int64) << 40 | place, kind="stable")
        own, place, size = own[order], place[order], size[order]
    return Asked(context, word, follower, at, hot, by, part, own, place, size)


def _pairs(run: Run, hot: np.ndarray, parts: int) -> Asked:
    """``hot``: names of the words that very many others follow, sorted."""
    end = int(np.flatnonzero(run.words == word_keys(_END))[0])
    names, everywhere = run.words >> _CUT, np.ones(len(run.code), dtype=bool)
    return _asked(names, names, _shifted(run.code, run.offsets, end), run.code, everywhere, _find(hot, names)[1], np.zeros(len(names), dtype=bool), parts)


def _longer(run: Run, shorter: Asked, names: np.ndarray, level: np.ndarray, cut: int, parts: int) -> tuple[Asked, np.ndarray, np.ndarray]:
    """N-grams one word longer than ``shorter``, whose keys are ``names`` and whose levels are known; also each token's context (-1: none), and contexts' names.

    An n-gram is asked for if its first words and its last are stored; a context is if it is stored.
    """
    stored = level > 0
    back = _shifted(shorter.at, run.offsets, -1)
    back[(back >= 0) & ~stored[back]] = -1
    kept = (back >= 0) & (shorter.at >= 0)
    kept[kept] = stored[shorter.at[kept]]
    named, alone = names >> _CUT, np.zeros(len(names), dtype=bool)
    alone[back[back >= 0]] = True
    asked = _asked(named, run.words >> _CUT, np.maximum(back, 0), run.code, kept, level_value(level) >= cut, alone, parts)
    return asked, back, named


def _sent(asked: Asked, names: np.ndarray, learned: np.ndarray, flush: int) -> Iterator[tuple]:
    """One row a part: contexts, lengths of their stretches (and whether they are hot), different followers, which of these each n-gram has, counts in the texts learned from."""
    n = np.bincount(asked.at[learned & (asked.at >= 0)], minlength=len(asked.by))[asked.by]
    names, length, word = names[asked.place], asked.size * 2 + asked.hot[asked.place], asked.word[asked.by]
    different, back = _different(_both(asked.part, word))
    of = np.empty(len(different), dtype=np.uint64)
    of[back] = asked.follower[asked.by]
    owner = different >> _HALF
    for i in np.unique(asked.own).tolist():
        some, those, words = (slice(*np.searchsorted(x, np.array([i, i + 1], dtype=x.dtype))) for x in (asked.own, asked.part, owner))
        which = back[those] - words.start
        yield i, flush, _short(names[some]), _squeezed(_small(length[some])), _short(of[words]), _planes(which, _width(words.stop - words.start)), _squeezed(_small(n[those]))


_SENT = "part bigint, flush bigint, a binary, b binary, c binary, d binary, e binary"
#: Answers to a run (``flush``) about n-grams of ``size`` words; with no run, numbers of the whole input by ``key``.
_ANSWER = "flush bigint, size int, part bigint, level binary, mass binary, n binary, key bigint, total bigint"


def _batch(rows: Sequence[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    names, of = zip(*(x.split() for x in schema.split(", ")))
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(cols, of)], list(names))


def _by_part(batches: Iterator[pa.RecordBatch], close) -> Iterator[pa.RecordBatch]:
    """``close`` on the rows of each part, which follow each other."""
    now, held = None, []
    for batch in batches:
        for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now and held:
                yield _batch(close(now, held), _ANSWER)
                held = []
            now = part
            held.append(row)
    if held:
        yield _batch(close(now, held), _ANSWER)


def _words_answered(cut: int):
    """Exact counts of words; those of ``cut`` or more by name too, and how many words and tokens there are."""

    def close(part: int, held: list[list]) -> list[tuple]:
        keys, n = [np.frombuffer(r[1], dtype=np.uint64) for r in held], [_counts(r[2], len(r[1]) // 8) for r in held]
        different, back = _different(np.concatenate(keys))
        count = np.bincount(back, weights=np.concatenate(n), minlength=len(different)).astype(np.int64)
        out = [(None, 0, part, None, None, None, None, int(count.sum())), (None, 1, part, None, None, None, None, int((count > 0).sum()))]
        out += [(None, 2, part, None, None, None, int(k), None) for k in different[count >= cut] >> _CUT]
        for r, b in zip(held, np.split(back, np.cumsum([len(k) for k in keys])[:-1])):
            out.append((r[0], 1, part, None, None, _squeezed(_small(count[b], "<u8")), None, None))
        return out

    return close


def _grams_answered(order: int, last: bool):
    """Pieces of the filter: filled with some of the part's n-grams, at the levels that their counts reach, and read for each of these that is asked for.

    Also what a context's n-grams hold (in quarters, which is exact), and the exact counts of those that are found, if they may be contexts of longer ones.
    """

    def close(part: int, held: list[list]) -> list[tuple]:
        names = [_long(r[1]) for r in held]
        size = np.concatenate([_counts(_loose(r[2]), len(x)) for r, x in zip(held, names)])
        hot, size = (size & 1).astype(bool), size >> 1
        different, place = _different(np.concatenate(names))
        of = np.repeat(place, size)
        stretches = np.cumsum([0, *(len(x) for x in names)])
        ends = np.concatenate(([0], np.cumsum(size)))[stretches]
        follower, n = np.empty(len(of), dtype=np.uint64), np.empty(len(of), dtype=np.uint32)
        for r, lo, hi in zip(held, ends, ends[1:]):
            words = _long(r[3])
            follower[lo:hi] = words[_numbers(r[4], _width(len(words))).astype(np.int64)]
            n[lo:hi] = _counts(_loose(r[5]), hi - lo)
            del r[1:]
        level, counts, mass = np.zeros(len(of), dtype=np.uint8), np.zeros(0 if last else len(of), dtype=np.int64), np.zeros(len(different), dtype=np.int64)
        pieces = 1 + len(of) // PIECE
        piece = follower.astype("<u8", copy=False).view("<u2")[::4] % np.uint16(pieces)
        for i in range(pieces):
            some = np.flatnonzero(piece == i) if pieces > 1 else np.arange(len(of))
            gram, back = _different(_gram_keys(different[of[some]], follower[some]))
            count = np.bincount(back, weights=n[some], minlength=len(gram)).astype(np.int64)
            context = np.empty(len(gram), dtype=np.int64)
            context[back] = of[some]
            stored = count >= LEAST
            true = level_of(count[stored])
            bits = bits_for(int(BITS_EACH * stored.sum() + HIGHER_BITS * (true - LEAST).sum()), 1 << 62, 1)
            bitmap = entered(bits, gram[stored], np.full(len(true), LEAST), true, PROBES, HIGHER_PROBES)
            level[some] = level_of(log_frequency(bitmap, gram))[back]
            mass += np.bincount(context[stored], weights=(level_value(true) - DISCOUNT) * 4, minlength=len(different)).astype(np.int64)
            if not last:
                counts[some] = count[back]
        is_hot = np.zeros(len(different), dtype=bool)
        is_hot[place[hot]] = True
        out = [(None, order, part, None, None, None, int(k), int(x)) for k, x in zip(different[is_hot], mass[is_hot])]
        mass[is_hot] = 0
        for k, r in enumerate(held):
            found = level[ends[k] : ends[k + 1]]
            n_of = None if last else _squeezed(_small(counts[ends[k] : ends[k + 1]][found > 0], "<u8"))
            out.append((r[0], order, part, _squeezed(found.tobytes()), _squeezed(_small(mass[place[stretches[k] : stretches[k + 1]]], "<u8")), n_of, None, None))
        return out

    return close


def _heard(rows: Sequence[tuple], stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels, what contexts hold, and counts of what was found, of all answers about one order, by part; ``stretches``: the part of each context asked for."""
    k = np.bincount(stretches, minlength=1)
    level = [np.frombuffer(_loose(r[1]), dtype=np.uint8) for r in rows]
    mass = [_counts(_loose(r[2]), int(k[r[0]]), "<u8") for r in rows]
    n = [_counts(_loose(r[3]), int(np.count_nonzero(x)), "<u8") for r, x in zip(rows, level) if r[3] is not None]
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (level, mass, n))


@dataclass(frozen=True)
class Known:
    """Of one order, by n-gram: its level and exact count (0 where it is not found); by context: what its n-grams hold."""

    level: np.ndarray
    count: np.ndarray
    mass: np.ndarray


def _known(asked: Asked, names: np.ndarray, rows: Sequence[tuple], hot: tuple[np.ndarray, np.ndarray]) -> Known:
    found, held, n = _heard(rows, asked.own)
    level = np.zeros(len(asked.by), dtype=np.int64)
    level[asked.by] = found
    count = np.zeros(len(level), dtype=np.int64)
    count[asked.by[found > 0]] = n if len(n) else 0
    mass = np.zeros(len(names), dtype=np.int64)
    mass[asked.place] = held
    at, is_hot = _find(hot[0], names)
    mass[is_hot & asked.hot] = hot[1][at[is_hot & asked.hot]]
    return Known(level, count, mass / 4)


def _with_answers(runs: DataFrame, answers: Sequence[DataFrame]) -> DataFrame:
    """Each run, then the answers to it, by order and part."""
    kinds = {"size": "int", "part": "bigint", "level": "binary", "mass": "binary", "n": "binary"}
    first = runs.withColumns({c: F.lit(0 if c in ("size", "part") else None).cast(k) for c, k in kinds.items()})
    for a in answers:
        first = first.unionByName(a.filter("flush IS NOT NULL").select("flush", *kinds), allowMissingColumns=True)
    return first.repartition("flush").sortWithinPartitions("flush", "size", "part")


def _each_run(batches: Iterator[pa.RecordBatch], ids: bool = False) -> Iterator[tuple]:
    """Number, run, ids (where wanted), and the answers by order."""
    now = None
    for batch in batches:
        col = {c: batch.column(c) for c in batch.schema.names}
        for k, (size, part) in enumerate(zip(col["size"].to_pylist(), col["part"].to_pylist())):
            if size == 0:
                if now:
                    yield now
                run = _unpacked(*(col[c][k].as_py() for c in ("sizes", "training", "words", "code")))
                now = col["flush"][k].as_py(), run, pa.concat_arrays([col["ids"][k].values]) if ids else None, {}
            else:
                now[3].setdefault(size, []).append((part, *(col[c][k].as_py() for c in ("level", "mass", "n"))))
    if now:
        yield now


def _word_counts(run: Run, rows: Sequence[tuple], parts: int) -> np.ndarray:
    part = _home(run.words, parts)
    by, k = np.argsort(part, kind="stable"), np.bincount(part, minlength=parts)
    out = np.empty(len(by), dtype=np.int64)
    out[by] = np.concatenate([_counts(_loose(r[3]), int(k[r[0]]), "<u8") for r in rows])
    return out


def _home(words: np.ndarray, parts: int) -> np.ndarray:
    return ((mixed(words) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _following(run: Run, heard: dict[int, list[tuple]], hots: dict[int, tuple[np.ndarray, np.ndarray]], cut: int, parts: int, until: int) -> Iterator[tuple]:
    """By order, up to ``until``: what was asked for, each token's context, contexts' names, and what is known (None: not yet)."""
    asked, names = _pairs(run, hots[2][0], parts), run.words >> _CUT
    back, order = _shifted(run.code, run.offsets, int(np.flatnonzero(run.words == word_keys(_END))[0])), 2
    while True:
        known = _known(asked, names, heard.get(order, []), hots[order]) if order in hots and (order in heard or not len(asked.by)) else None
        yield order, asked, back, names, known
        if order == until:
            return
        keys = _gram_keys(names[asked.context], asked.follower)
        asked, back, names = _longer(run, asked, keys, known.level, cut, parts)
        order += 1


def scored(docs: DataFrame, training: Column, lengths: Sequence[int] = QUERY_ORDERS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Rows as of ``score``, by a model of the texts marked ``training``, and the number of tokens learned from. Nothing of the model is broadcast or joined by token.

    A run of texts (about ``FLUSH`` tokens) is written once, as places in its own words. It asks for its different words, then pairs, then triples: they go to parts by
    their hashes with their counts, a part makes its piece of the filter of all that it gets, reads it and answers each run. Pieces follow the input in number, not in size.
    Contexts with more than one token in ``HOT`` have their n-grams dealt to all parts; what these hold is summed and given to all tasks, ``HOT`` numbers an order at most.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"), training.alias("training"))
    kind = rows.schema["id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size, at = [], [], 0, TaskContext.get().partitionId() << 36

        def flush() -> pa.RecordBatch:
            run, k = _run_of(held), pa.concat_arrays(ids)
            cols = [pa.array([at]), pa.ListArray.from_arrays(pa.array([0, len(k)], pa.int32()), k), *(pa.array([x], pa.binary()) for x in _packed(run)), pa.array([len(run.code)])]
            return pa.RecordBatch.from_arrays(cols, ["flush", "ids", "sizes", "training", "words", "code", "tokens"])

        for batch in batches:
            for piece in slices(batch, most=SLICE):
                held.append((tokens(piece.column("text")), piece.column("training").to_numpy(zero_copy_only=False)))
                ids.append(piece.column("id"))
                size += len(held[-1][0].words)
                if size > FLUSH:
                    yield flush()
                    held, ids, size, at = [], [], 0, at + 1
        if held:
            yield flush()

    runs = _kept(rows.mapInArrow(write, f"flush bigint, ids array<{kind}>, sizes binary, training binary, words binary, code binary, tokens bigint"), "runs")
    all_ = runs.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    runs, parts, cut = runs.drop("tokens"), 1 + max(min(all_ // LESS, FEW), all_ // PART), 1 + all_ // HOT
    plain = runs.drop("ids")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flush, *x in zip(*(batch.column(c).to_pylist() for c in ("flush", "sizes", "training", "words", "code"))):
                run = _unpacked(*x)
                n, part = np.bincount(run.code[run.learned], minlength=len(run.words)), _home(run.words, parts)
                by = np.argsort(part, kind="stable")
                ends = np.cumsum(np.bincount(part, minlength=parts))
                out = [(i, flush, run.words[k].tobytes(), _small(n[k]), None, None, None) for i, k in enumerate(np.split(by, ends[:-1])) if len(k)]
                yield _batch(out, _SENT)

    def answered(sent: DataFrame, close, name: str) -> DataFrame:
        dealt = sent.repartition("part").sortWithinPartitions("part")
        return _kept(dealt.mapInArrow(lambda batches: _by_part(batches, close), _ANSWER), name, RUNS)

    answers = [answered(plain.mapInArrow(words, _SENT), _words_answered(cut), "words")]
    totals = answers[0].filter("flush IS NULL")
    n, v = (totals.filter(F.col("size") == k).agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0] for k in (0, 1))
    # at most HOT words reach the cut
    hot = np.sort(totals.filter("size = 2").select("key").distinct().toArrow().column("key").to_numpy()).view(np.uint64)
    hots = {2: (hot, np.zeros(len(hot), dtype=np.int64))}
    longest = max(lengths)
    for order in range(2, longest + 1):

        def ask(batches: Iterator[pa.RecordBatch], order: int = order, hots: dict = dict(hots)) -> Iterator[pa.RecordBatch]:  # noqa: B006
            for flush, run, _, heard in _each_run(batches):
                *_, (_, asked, _, names, _) = _following(run, heard, hots, cut, parts, order)
                yield _batch(list(_sent(asked, names, run.learned, flush)), _SENT)

        met = _with_answers(plain, answers[1:]) if order > 2 else plain.withColumns({"size": F.lit(0), "part": F.lit(0).cast("bigint")})
        answers.append(answered(met.mapInArrow(ask, _SENT), _grams_answered(order, order == longest), f"{order}-grams"))
        held = answers[-1].filter("flush IS NULL").groupBy("key").agg(F.sum("total").alias("total")).toArrow()  # hot contexts only
        key, total = held.column("key").to_numpy().view(np.uint64), held.column("total").to_numpy()
        by = np.argsort(key)
        hots[order] = key[by], total[by]
        if order == 2:  # what is hot stays as it was when pairs were asked for
            mass = np.zeros(len(hot), dtype=np.int64)
            at, there = _find(hots[2][0], hot)
            mass[there] = hots[2][1][at[there]]
            hots[2] = hot, mass
    whole = n + ALPHA * (v + 1)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, run, ids, heard in _each_run(batches, ids=True):
            k, text = len(run.offsets) - 1, np.repeat(np.arange(len(run.offsets) - 1), np.diff(run.offsets))
            total = _word_counts(run, heard[1], parts)
            single, is_known = ((total + ALPHA) / whole), total > 0
            p = single[run.code]
            for order, asked, back, _, known in _following(run, heard, hots, cut, parts, longest):
                if order in lengths:
                    inside = np.flatnonzero(back >= 0)
                    inside = inside[known.mass[back[inside]] > 0]  # in other contexts no n-gram is stored
                    of = back[inside]
                    at, t = asked.at[inside], np.maximum(total[of], 1)
                    q = np.where(at >= 0, level_value(known.level)[at] if len(known.level) else 0, 0)
                    p[inside] = np.maximum(q - DISCOUNT, 0) / t + np.maximum(1 - known.mass[of] / t, 0) * p[inside]
                total = known.count
            sums = (np.bincount(text, weights=x, minlength=k) for x in (np.log10(single)[run.code], np.log10(np.minimum(p, 1.0))))
            known_ = np.bincount(text, weights=is_known[run.code], minlength=k).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(run.offsets)), pa.array(known_), *map(pa.array, sums)], [id_col, "n_tokens", "n_known", "base_score", "score"])

    schema = f"`{id_col}` {kind}, n_tokens bigint, n_known bigint, base_score double, score double"
    return _kept(_with_answers(runs, answers).mapInArrow(finish, schema), "scores", RUNS), n


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    held_out = remainder("doc_id", FOLDS) == 0
    found, n = scored(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op6_lm_score": op6_lm_score}
ORACLE_SQL: dict[str, str] = {}

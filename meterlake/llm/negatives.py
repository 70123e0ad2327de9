"""Hard-negative mining by a secondary sort.

A pair of an anchor and a row is one packed key: anchor, falling score, kind (a positive before a negative of the same
score), id. Keys are dealt by their anchor and sorted inside partitions (the DataFrame form of
``repartitionAndSortWithinPartitions``), and an iterator reads them in order: each of an anchor's first positives opens a window of scores,
a negative goes to every open window that holds its score, a full or passed window is closed. It keeps at most ``POSITIVES``
windows, never an anchor's pairs.

Scores are made in blocks: rows are dealt over chunks and anchors over groups, both of bounded size, and every chunk meets every group
once. Not all pairs move: a cell keeps of its scores each anchor's first positives, and in a second pass,
when the windows are known, each window's first negatives. As windows only ask for first ones, nothing that counts is left out.
No key gathers rows: neither a frequent label nor a repeated id has a place in how rows are dealt.

A row takes part if its id and label are there and its vector has only finite components. Components are
``floor(scale * x)``, scores are exact integers.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part, and neither do rows whose
scores could pass 62 bits (a sum of squared components of 2 ** 62 or more); a shorter vector counts as followed by zeros, an empty one has
score 0 with all; rows of an anchor's own id are never its positives; repeated rows are rows each, repeated anchors
give their rows as often; ties go to the smaller id; an anchor without positives or windows without
negatives give no rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.shared import materialize
from meterlake.sources.tables import table

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these per cents of the positive's.
LOW, HIGH = 50, 95
#: Rows of a chunk at least and at most, anchors of a group at most, scores that a task holds at a time.
LEAST_CHUNK, CHUNK, GROUP, BLOCK = 1 << 10, 1 << 16, 1 << 16, 1 << 21

#: 33 bytes whose order is that of anchors, falling scores, positives first, ids.
_KEY = np.dtype([("anchor", ">u8"), ("row", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_PAIRS = "key binary, times bigint"
_SIGN = np.uint64(1 << 63)


def vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = 256) -> DataFrame:
    """``id``, ``label``, ``v`` (integers) of the rows that take part."""
    raw = rows.select(rows[id_col].cast("bigint").alias("id"), label.cast("bigint").alias("label"), rows[vector_col].alias("raw"))
    finite = F.forall("raw", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    part = raw.filter("id IS NOT NULL AND label IS NOT NULL AND raw IS NOT NULL").filter(finite)
    wide = part.withColumn("raw", F.transform("raw", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double")))
    small = F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x) < F.lit(float(1 << 62))
    return wide.filter(small).select("id", "label", F.col("raw").cast("array<int>").alias("v"))


def _signed(x: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones in the same order, and back."""
    return x.view(np.uint64) ^ _SIGN


def _read(keys: pa.Array) -> np.ndarray:
    fixed = keys.cast(pa.binary(_KEY.itemsize))
    return np.frombuffer(fixed.buffers()[1], dtype=_KEY)[fixed.offset : fixed.offset + len(fixed)] if len(fixed) else np.zeros(0, dtype=_KEY)


def _plain(field: np.ndarray) -> np.ndarray:
    return (field.astype(np.uint64) ^ _SIGN).view(np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max(initial=0))
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _firsts(scores: np.ndarray, n: int, lowest: float | int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``n`` times: lines that have a score left, and the place of their highest (the first of equal ones), which is then taken out."""
    lines = np.arange(len(scores))
    for _ in range(min(n, scores.shape[1])):
        at = scores.argmax(axis=1)
        found = scores[lines, at] > lowest
        yield lines[found], at[found]
        scores[lines, at] = lowest


def _bounds(p: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the highest score n with low * p <= 100 * n <= high * p, without passing 64 bits."""
    q, m = np.divmod(p, 100)
    return low * q - np.floor_divide(-low * m, 100), high * q + high * m // 100


def _cell(want: Callable[[np.ndarray, np.ndarray, np.ndarray, dict, slice], np.ndarray], kind: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What ``want`` picks of a chunk's rows for a group's anchors, as packed pairs."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        ids = rows["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        a = {c: anchors[c].to_numpy() for c in ("id", "label", "row", "times")} | ({"positives": _matrix(anchors["positives"])} if "positives" in anchors.column_names else {})
        ids, labels, v, w = ids[order], rows["label"].to_numpy()[order], _matrix(rows["v"])[order], _matrix(anchors["v"])
        width = min(v.shape[1], w.shape[1])
        v, w = v[:, :width], w[:, :width]
        far = np.sqrt((v.astype(float) ** 2).sum(axis=1).max(initial=0)) * np.sqrt((w.astype(float) ** 2).sum(axis=1).max(initial=0))
        exact = np.float64 if far < 1 << 52 else np.int64  # products of doubles are whole numbers up to 2 ** 53
        v, w = v.astype(exact).T.copy(), w.astype(exact)
        keys, times = [], []
        step = max(1, BLOCK // max(1, len(ids)))
        for lo in range(0, len(w) if len(ids) else 0, step):
            some = slice(lo, lo + step)
            scores = w[some] @ v
            line, at, score = want(scores, ids, labels, a, some)
            key = np.zeros(len(line), dtype=_KEY)
            key["anchor"], key["row"] = _signed(a["id"][some][line]), a["row"][some][line].view(np.uint64)
            key["score"], key["kind"], key["id"] = _signed(~score.astype(np.int64)), kind, _signed(ids[at])
            keys.append(key.tobytes())
            times.append(a["times"][some][line])
        data = b"".join(keys)
        n = len(data) // _KEY.itemsize
        ends = pa.py_buffer((np.arange(n + 1, dtype=np.int64) * _KEY.itemsize).astype(np.int32).tobytes())
        packed = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(data)])
        return pa.table({"key": packed, "times": pa.array(np.concatenate(times) if times else np.zeros(0, np.int64), pa.int64())})

    return run


def _lowest(scores: np.ndarray) -> float | int:
    return -np.inf if scores.dtype == np.float64 else np.iinfo(np.int64).min


def _positives(most: int) -> Callable:
    def want(scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, a: dict, some: slice) -> tuple[np.ndarray, ...]:
        lowest, found = _lowest(scores), []
        left = np.where((labels == a["label"][some, None]) & (ids != a["id"][some, None]), scores, lowest)
        for line, at in _firsts(left, most, lowest):
            found.append((line, at, scores[line, at]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    return want


def _negatives(most: int, low: int, high: int) -> Callable:
    def want(scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, a: dict, some: slice) -> tuple[np.ndarray, ...]:
        lowest, places = _lowest(scores), [np.zeros(0, np.int64)]
        others = np.where(labels != a["label"][some, None], scores, lowest)
        least, top = _bounds(a["positives"][some], low, high)
        for k in range(least.shape[1]):
            left = np.where((others >= least[:, k, None]) & (others <= top[:, k, None]), others, lowest)
            for line, at in _firsts(left, most, lowest):
                places.append(line * scores.shape[1] + at)
        line, at = np.divmod(np.unique(np.concatenate(places)), max(1, scores.shape[1]))
        return line, at, scores[line, at]

    return want


def _ordered(pairs: DataFrame) -> DataFrame:
    """Keys dealt by anchor and sorted inside partitions."""
    return pairs.repartition(F.substring("key", 1, 16)).sortWithinPartitions("key")


def _first_positives(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = b"", 0
        for b in batches:
            if not b.num_rows:
                continue
            key = _read(b.column("key"))
            who = np.stack([key["anchor"].astype(np.uint64), key["row"].astype(np.uint64)])
            new = np.concatenate(([True], (who[:, 1:] != who[:, :-1]).any(axis=0)))
            starts = np.flatnonzero(new)
            number = np.arange(len(key)) - starts[np.cumsum(new) - 1]
            if key[:1].tobytes()[:16] == last:
                number[: starts[1] if len(starts) > 1 else len(key)] += seen
            last, seen = key[-1:].tobytes()[:16], int(number[-1]) + 1
            kept = b.filter(pa.array(number < most))
            key = key[number < most]
            cols = [_plain(key["anchor"]), key["row"].astype(np.uint64).view(np.int64), ~_plain(key["score"])]
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, cols)], ["key", "times", "anchor", "row", "score"])

    return run


_OUT = {"anchor_id": pa.int64(), "positive_id": pa.int64(), "rank": pa.int32(), "negative_id": pa.int64(), "positive_score": pa.int64(), "negative_score": pa.int64(), "times": pa.int64()}


def _windows(most: int, low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, []
        for b in batches:
            key = _read(b.column("key"))
            score = ~_plain(key["score"])
            least, top = _bounds(score, low, high)
            rows = zip(_plain(key["anchor"]).tolist(), key["row"].tolist(), score.tolist(), key["kind"].tolist(), _plain(key["id"]).tolist(), least.tolist(), top.tolist(), b.column("times").to_pylist())
            out = []
            for anchor, row, s, negative, i, lo, hi, times in rows:
                if (anchor, row) != now:
                    now, open_ = (anchor, row), []
                if not negative:
                    open_.append([i, s, lo, hi, 0])
                    continue
                for w in open_:
                    if w[2] <= s <= w[3]:
                        w[4] += 1
                        out.append((anchor, w[0], w[4], i, w[1], s, times))
                open_ = [w for w in open_ if w[4] < most and w[2] <= s]  # full, or passed
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _OUT.values())], list(_OUT))

    return run


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (int), ``negative_id``, ``positive_score``, ``negative_score``; both inputs as of ``vectors``."""
    spark = rows.sparkSession
    n, some = rows.count(), anchors.count()
    each = min(chunk, max(min(LEAST_CHUNK, chunk), -(-n // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    chunks, groups = max(1, -(-n // each)), max(1, -(-some // group))
    dealt = rows.withColumn("chunk", F.pmod(F.monotonically_increasing_id(), F.lit(chunks)).cast("int"))
    dealt = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("chunk", "group")
    asked = anchors.groupBy("id", "label", "v").agg(F.count(F.lit(1)).alias("times")).withColumn("row", F.xxhash64("label", "v"))

    def cells(asked: DataFrame, want: Callable, kind: int) -> DataFrame:
        spread = asked.withColumn("group", F.pmod(F.xxhash64("id", "row"), F.lit(groups)).cast("int"))
        spread = spread.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        spread = spread.select(*(F.col(c).alias(c) for c in spread.columns)).groupBy("chunk", "group")  # columns apart from those of the rows
        return dealt.cogroup(spread).applyInArrow(_cell(want, kind), _PAIRS)

    near = _ordered(cells(asked, _positives(positives), 0))
    near = materialize(near.mapInArrow(_first_positives(positives), f"{_PAIRS}, anchor bigint, row bigint, score bigint"), "positives")
    known = near.groupBy(F.col("anchor").alias("id"), "row").agg(F.collect_list("score").alias("positives"))
    far = cells(asked.join(known, ["id", "row"]), _negatives(negatives, low, high), 1)
    found = _ordered(near.select("key", "times").union(far)).mapInArrow(_windows(negatives, low, high), ", ".join(f"{c} {'int' if t == pa.int32() else 'bigint'}" for c, t in _OUT.items()))
    return found.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 50, among all rows."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(rows["vec_id"] % 7 == 0, (rows["label"].cast("bigint") + 1) % 10).otherwise(rows["label"].cast("bigint"))
    found = vectors(rows, "vec_id", "embedding", label)
    return mine(found, found.filter("id % 50 = 0"))


_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0
), positive AS (
  SELECT * FROM scored WHERE alike AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), met AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INT AS rank
  FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 3
"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE_SQL = {"op13_hard_negatives": _SQL}

"""Quality classifier: quadratic discriminant with shrunken class covariances over statistics of a text.

A text becomes twelve numbers, logarithms of lengths and of shares (characters by
kind, distinct words, words and lines that repeat). Spark sums their first and second
moments by class over all labelled training rows, in one aggregation of fixed size;
the driver sees only those sums. Each class covariance is drawn towards the pooled
one (``POOLED``) and then towards a multiple of the identity (``RIDGE``), and
factored once (Cholesky). A score is the logistic of the difference of the classes' log densities: squared
Mahalanobis distances by the cached factors, log determinants and log priors.

Labels, language, source and id are no inputs of a score. Rows whose crc32 of the id
as text is 0 modulo ``FOLDS`` are held out from training.

Defined results: null text is read as empty, and an empty text has a score like any
other; labels that are null or neither 0 nor 1 and labels of unknown ids are
ignored, repeated labels count each; a null id matches no label and stays null;
repeated rows are scored each; an empty table gives no rows. If a class has no
training rows, every score is the share of class 1 among training rows, and one
half where there are none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.bitmap import bits_for, build, contains
from meterlake.llm.shared import materialize, remainder, text_of
from meterlake.sources.tables import table

FOLDS, THRESHOLD = 5, 0.3
POOLED, RIDGE = 0.3, 0.01
#: Bits of the filter of labelled ids, at most.
FILTER_BITS = 1 << 27

#: Kinds of bytes: lower case, then capitals, digits, blanks, line breaks, punctuation, shouting, symbols, non-ASCII.
_KIND = np.full(256, 7, dtype=np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:'\"()-", b"!?")):
    _KIND[list(_chars)] = _k
_KIND[128:] = 8
_SHARES = [1, 2, 4, 5, 6, 7, 8]
#: Usual shares of these kinds, which count like so many bytes of every text, so that a few words do not look extreme.
_USUAL, _WEIGHT = np.array([0.02, 0.002, 0.004, 0.02, 0.001, 0.001, 0.02]), 100

FEATURES = (
    "words", "word_length", "distinct_words", "words_like_the_one_before", "repeated_lines",
    "capitals", "digits", "breaks", "punctuation", "shouting", "symbols", "non_ascii",
)
D = len(FEATURES)


def features(text: str) -> np.ndarray:
    raw = text.encode()
    n = len(raw)
    kinds = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=9)
    words = raw.split()
    k = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    repeated = len(lines) - len(set(lines))
    out = np.empty(D)
    out[0] = k + 1
    out[1] = (n + _WEIGHT / 4) / (k + _WEIGHT / 20)
    out[2] = (len(set(words)) + 1) / (k + 1)
    out[3] = (same + 0.5) / (k + 10)
    out[4] = (repeated + 0.5) / (len(lines) + 2)
    out[5:] = (kinds[_SHARES] + _WEIGHT * _USUAL) / (n + _WEIGHT)
    return np.log(out)


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: np.ndarray | None = None) -> DataFrame:
    """``id_col`` and ``x``, an array of the twelve numbers; only of rows whose id is in the filter ``wanted``, if there is one."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"), F.xxhash64(docs[id_col]).alias("hash"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if shared.value is not None:
                b = b.filter(pa.array(contains(shared.value, b.column("hash").to_numpy().view(np.uint64))))
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                x = np.array([features(t) for t in part.column("text").to_pylist()]).reshape(-1)
                x = pa.ListArray.from_arrays(pa.array(range(0, len(x) + 1, D), pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([part.column("id"), x], ["id", "x"])

    return rows.mapInArrow(run, f"id {kind}, x array<double>").withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Discriminant:
    """Mean and spread of the features, and for each class its mean, Cholesky factor's inverse, and constant."""

    centre: np.ndarray
    spread: np.ndarray
    means: tuple[np.ndarray, ...]
    whiten: tuple[np.ndarray, ...]
    constant: tuple[float, ...]
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.spread
        density = [c - 0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.whiten, self.constant)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def discriminant(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant:
    """From each class's row count, sum of x and sum of x xᵀ."""
    n = sum(m[0] for m in moments.values())
    share = moments[1][0] / n if 1 in moments else 0.0 if n else 0.5
    none = np.zeros(D)
    if set(moments) != {0, 1}:
        return Discriminant(none, none, (), (), (), share)
    centre = sum(m[1] for m in moments.values()) / n
    spread = np.sqrt(np.maximum(np.diag(sum(m[2] for m in moments.values())) / n - centre**2, 0)) + 1e-6
    means, covs = [], []
    for c in (0, 1):
        k, s, ss = moments[c]
        mean = s / k
        covs.append((ss / k - np.outer(mean, mean)) / np.outer(spread, spread))
        means.append((mean - centre) / spread)
    both = sum(moments[c][0] / n * covs[c] for c in (0, 1))
    whiten, constant = [], []
    for c in (0, 1):
        cov = (1 - pooled) * covs[c] + pooled * both
        cov = (1 - ridge) * cov + (ridge * np.trace(cov) / D + 1e-9) * np.eye(D)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        constant.append(float(np.log(moments[c][0] / n) - np.log(np.diag(factor)).sum()))
    return Discriminant(centre, spread, tuple(means), tuple(whiten), tuple(constant), share)


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> Discriminant:
    """The discriminant of the training rows (those not held out) of ``rows`` (id, ``x``) that have a label."""
    known = labels.select(labels[id_col].alias("__id"), labels[label].cast("int").alias("y")).filter("y IN (0, 1)")
    train = rows.filter(remainder(id_col, FOLDS) != 0)
    train = train.join(known, train[id_col] == known["__id"]).select("y", *(F.get("x", F.lit(i)).alias(f"x{i}") for i in range(D)))
    upper = [(i, j) for i in range(D) for j in range(i, D)]
    sums = train.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(f"x{i}") for i in range(D)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in upper)
    )
    moments = {}
    for row in sums.collect():  # two rows
        second = np.zeros((D, D))
        for (i, j), v in zip(upper, row[2 + D :]):
            second[i, j] = second[j, i] = v
        moments[row["y"]] = (row["n"], np.array(row[2 : 2 + D]), second)
    return discriminant(moments)


def score_of(x: Column, model: Discriminant) -> Column:
    """The score of a column of feature arrays."""

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(rows.to_numpy())) if len(rows) else [], dtype="float64")

    return score(x)


def text_score_of(text: Column, model: Discriminant) -> Column:
    """The score of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([features(t) for t in texts]).reshape(-1, D)), dtype="float64")

    return score(text_of(text))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents scored under ``threshold``; texts are scored where they are read, not shuffled."""
    ids = labels.filter("quality IN (0, 1)").select(F.xxhash64(labels[id_col].cast(docs.schema[id_col].dataType)).alias("key"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    labelled = build(ids, bits_for(ids.count(), FILTER_BITS))  # a full filter would cost time only: ``fit`` joins by id
    model = fit(feature_rows(docs, id_col, text_col, labelled), labels, id_col)
    return docs.filter(text_score_of(docs[text_col], model) >= threshold)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    rows = materialize(feature_rows(table(spark, sf_dir, "documents")), "features")
    model = fit(rows, table(spark, sf_dir, "labels"))
    scored = rows.select("doc_id", (remainder("doc_id", FOLDS) == 0).alias("held_out"), score_of(F.col("x"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
ORACLE_SQL: dict[str, str] = {}

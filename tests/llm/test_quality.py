import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import quality as Q


def test_scores_match_a_plain_discriminant():
    rng = np.random.default_rng(1)
    x = {0: rng.normal(1, 2, (200, Q.D)), 1: rng.normal(0, 1, (500, Q.D))}
    model = Q.discriminant({c: (len(v), v.sum(axis=0), v.T @ v) for c, v in x.items()})
    z = np.vstack([x[0], x[1]])
    centre, spread = z.mean(axis=0), z.std(axis=0) + 1e-6
    covs = {c: np.cov(((v - centre) / spread).T, bias=True) for c, v in x.items()}
    both = (200 * covs[0] + 500 * covs[1]) / 700
    density = []
    for c in (0, 1):
        cov = (1 - Q.POOLED) * covs[c] + Q.POOLED * both
        cov = (1 - Q.RIDGE) * cov + Q.RIDGE * np.trace(cov) / Q.D * np.eye(Q.D)
        d = (z - x[c].mean(axis=0)) / spread
        density.append(np.log(len(x[c]) / 700) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.scores(z), 1 / (1 + np.exp(density[0] - density[1])), atol=1e-6)


def test_awkward_rows_and_one_class(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, None, 0), (99, 0, 0), (None, 1, 0), (12, 7, 0)], "doc_id bigint, quality int, toxic int")
    rows = Q.feature_rows(docs)
    model = Q.fit(rows, labels)
    assert model.means == () and model.share == 1.0
    scored = rows.select("doc_id", Q.score_of(F.col("x"), model).alias("s")).collect()
    assert len(scored) == docs.count() and {r["s"] for r in scored} == {1.0}
    assert Q.fit(Q.feature_rows(no_docs), labels).share == 0.5
    assert Q.keep_good(no_docs, labels).count() == 0 and Q.keep_good(docs, labels).columns == docs.columns


def test_held_out_rows_and_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = Q.op2_quality_classifier(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for h, i in zip(got["held_out"], got["doc_id"]))
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.97
    assert held["score"].between(0, 1).all() and ((held["score"] >= 0.3) == (held["predicted"] == 1)).all()


@pytest.mark.parametrize("text", ["", "a", "\n\n", "é" * 9, "x " * 20000])
def test_features_are_finite(text):
    assert np.isfinite(Q.features(text)).all()

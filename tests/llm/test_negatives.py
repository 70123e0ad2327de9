import math
import random

from pyspark.sql import functions as F

from meterlake.llm import negatives as N

COLUMNS = "vec_id bigint, embedding array<float>, label int, id string, row string, v string, chunk string, times string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", "z", "z", "z", "z") for r in rows], COLUMNS)


def mined(df, **sizes):
    found = N.vectors(df, "vec_id", "embedding", df["label"])
    return sorted(tuple(r) for r in N.mine(found, found.filter("id % 5 = 0"), **sizes).collect())


def plain(rows, positives=5, negatives=3):
    usable = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in usable]
    out = []
    for i, v, y in whole:
        if i % 5:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in whole)
        for s, j, z in [x for x in scored if x[2] == y and x[1] != i][:positives]:
            fit = [(n, k) for n, k, u in scored if u != y and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(i, j, rank, k, -s, -n) for rank, (n, k) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def awkward(seed, n):
    rng = random.Random(seed)
    vector = lambda: [rng.choice([0.0, 0.25, 0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(rng.choice([6, 6, 6, 4, 0]))]
    rows = [(rng.randrange(-n, n), vector(), rng.randrange(3)) for _ in range(n)]
    rows += [rows[0], rows[0], (5, [1.0] * 6, 1), (5, [1.0] * 6, 1), (10, [0.0] * 6, 2), (11, [0.0] * 6, 0), (9, [0.0] * 6, 2)]
    rows += [(None, vector(), 1), (15, None, 1), (20, [1.0, None], 1), (25, [float("nan")], 1), (30, [float("inf")], 1), (35, vector(), None)]
    return rows + [(40 + i, [0.75] * 6, 1) for i in range(60)]  # a label and a vector with many rows


def test_equals_a_plain_search(spark):
    rows = awkward(3, 150)
    want = plain(rows)
    assert len(want) > 300 and any(p == 0 for *_, p, _ in want)
    df = frame(spark, rows).repartition(3)
    assert mined(df) == want
    assert mined(df, chunk=16, group=7) == want


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(2.0**20, 2.0**21) for _ in range(4)], i % 2) for i in range(40)]
    df = frame(spark, rows)
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in df.collect()]  # as the column holds them
    assert mined(df) == plain(rows)
    assert mined(frame(spark, [*rows, (50, [1e30], 0)])) == plain(rows)


def test_empty_tables(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(5, [1.0], 1)])) == []


def test_bounds_equal_the_inequality():
    import numpy as np

    p = np.arange(-400, 400)
    for x, lo, hi in zip(p.tolist(), *(b.tolist() for b in N._bounds(p, 50, 95))):
        assert [n for n in range(-500, 500) if 50 * x <= 100 * n <= 95 * x] == list(range(max(lo, -500), hi + 1))


def test_plan_shuffles_keys_and_blocks_only(spark):
    df = frame(spark, awkward(5, 40))
    found = N.vectors(df, "vec_id", "embedding", df["label"])
    plan = N.mine(found, found.filter(F.col("id") % 5 == 0))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan

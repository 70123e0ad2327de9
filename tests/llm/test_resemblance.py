import random

import pytest
from pyspark.sql import functions as F

from meterlake.llm import resemblance as R
from tests.llm.conftest import words


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def plain_groups(rows):
    """Smallest id reachable over links of 0.8 or more, by position; ids may be null."""
    held, parent = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(held[i] & held[j])
            if both * 5 >= 4 * (len(held[i]) + len(held[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(rows))]


def near_rows():
    """Texts of 12 to 600 words, each with copies that have one to many words changed, and chains of such copies."""
    rng, rows = random.Random(4), []
    for n in (12, 40, 90, 200, 600):
        for _ in range(4):
            base = words(rng, n).split()
            rows.append((len(rows), " ".join(base)))
            for k in range(1, 7):
                copy = list(base)
                for at in rng.sample(range(n), min(n, 1 + n * k // 120)):
                    copy[at] = "changed" + str(rng.random())
                rows.append((len(rows), " ".join(copy)))
                if k == 2:
                    base = copy
    return rows


@pytest.mark.parametrize("slice_items", [R.SLICE, 300])
def test_near_copies_equal_a_plain_version(spark, slice_items):
    rows = near_rows()
    got = R.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), slice_items=slice_items).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for (i, _), c in zip(rows, plain_groups(rows))}


def test_awkward_rows(spark, docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted((str(i), str(c)) for (i, _), c in zip(rows, plain_groups(rows)))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in R.near_copies(docs).collect()) == want
    assert R.near_copies(no_docs).count() == 0 and R.drop_near_copies(no_docs).count() == 0


def test_the_stage_drops_copies_that_differ_in_many_bits(spark):
    import corpus_pipeline as P
    from tests.llm.test_simhash import plain_print

    rng = random.Random(1)
    base = words(rng, 100).split()
    copy = [w if k not in (30, 70) else "other" for k, w in enumerate(base)]
    texts = [" ".join(base), " ".join(copy), words(rng, 100)]
    assert (plain_print(texts[0]) ^ plain_print(texts[1])).bit_count() > 3
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in P.near_dedup(spark, rows, "").collect()) == [0, 2]


def test_the_stages_after_it_against_a_plain_version(spark):
    from collections import defaultdict

    import corpus_pipeline as P
    from meterlake.llm.decontam import contamination
    from meterlake.llm.packing import encoder
    from meterlake.llm.secrets import redact_text, scan_text

    d = "/root/testdata/sf0.001"
    first = P.quality(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    schema, rows = first.schema, first.collect()
    keep = {r["doc_id"] for r, c in zip(rows, plain_groups([(r["doc_id"], r["text"]) for r in rows])) if r["doc_id"] == c}
    second = P.near_dedup(spark, spark.createDataFrame(rows, schema), d).collect()
    assert {r["doc_id"] for r in second} == keep
    leaks = {r["doc_id"] for r in contamination(spark.createDataFrame(second, schema), spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    encode, got = encoder(), defaultdict(int)
    for r in P.run(spark, d).collect():
        got[r["doc_id"]] += r["length"]
    clean = {r["doc_id"]: redact_text(r["text"], scan_text(r["text"])) for r in second if r["doc_id"] not in leaks}
    assert got == {i: len(encode(t)) + 1 for i, t in clean.items()}


def test_close_fingerprints_are_candidates_without_any_band(spark):
    """Op8's fingerprints bring texts together by themselves, and the exact check judges them."""
    rng = random.Random(8)
    base = words(rng, 900).split()
    rows = [(0, " ".join(base)), (1, " ".join([*base[:-1], "changed"])), (2, words(rng, 900)), (3, " ".join(base).upper())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = R.prints(docs, "doc_id", "text", R.SHINGLE).withColumn("keys", F.array(F.xxhash64("fp")))
    prints = {r["doc_id"]: r for r in found.collect()}
    assert (prints[0]["simhash"] ^ prints[1]["simhash"]).bit_count() <= 3
    nodes = found.groupBy("fp").agg(F.max("size").alias("size"), F.max("keys").alias("keys"), F.max("simhash").alias("simhash"))
    got = R.links(docs, nodes, "text", R.SHINGLE, R.LIKE).collect()
    assert {frozenset(r) for r in got} == {frozenset((prints[0]["fp"], prints[1]["fp"]))}

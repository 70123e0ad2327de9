import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from meterlake.llm import substrings as S


def plain(rows):
    """(id, words, removed, kept) by looking at every window."""
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in texts:
        key = S._LAST if i is None else i
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(least.get(g, key), key)
    out = []
    for i, w in texts:
        key, gone = S._LAST if i is None else i, set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < key:
                gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return Counter(out)


def found(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in S.remove_repeats(df).collect())


def test_awkward_rows(spark, docs, no_docs):
    assert found(docs) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert S.remove_repeats(no_docs).count() == 0


def test_divided_groups_give_the_same_spans(spark, docs, monkeypatch):
    rng = random.Random(1)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(20)) + " " + passage) for i in range(200, 0, -1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    monkeypatch.setattr(S, "PARTS", 4)
    monkeypatch.setattr(S.repeated_spans, "__defaults__", ("doc_id", "text", 3, S.MAP_BITS))
    assert found(df) == plain(rows)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.lists(st.sampled_from("ab"), max_size=60).map(" ".join)), min_size=1, max_size=8))
def test_any_texts(spark, rows):
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == plain(rows)


def test_subtrees_hold_what_occurs_in_two_documents():
    rng = np.random.default_rng(2)
    steps = S.WINDOW - S.PREFIX
    for letters in (1, 2, 3):
        words = rng.integers(0, letters, 3000).astype(np.uint64) + np.uint64(1 << 63)
        at = np.sort(rng.choice(len(words) - steps, 900, replace=False))
        node, doc = rng.integers(0, 4, 900), rng.integers(0, 50, 900)
        part = (node == 3).astype(np.int64)
        met = {}
        for n, p, d in zip(node, at, doc):
            met.setdefault((n, *words[p : p + steps]), set()).add(d)
        want = {k: min(met[n, *words[p : p + steps]]) for k, (n, p) in enumerate(zip(node, at)) if len(met[n, *words[p : p + steps]]) > 1 or n == 3}
        alive, least = S._deep_nodes(node, words, at, doc, part)
        assert dict(zip(alive.tolist(), least.tolist())) == want
    lone = np.arange(3)
    assert not len(S._deep_nodes(lone, words, lone, lone, lone * 0)[0])


def test_query_digest(spark):
    d = "/root/testdata/sf0.001"
    want = plain([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.op7_substring_dedup(spark, d).collect())
    assert got == Counter((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in want)


def test_one_word_over_and_over_and_copies_of_one_row(spark):
    """Few rows go on from divided groups, whatever the number of places and copies; and results are those of a small group."""
    rng = random.Random(3)
    text, passage = "same " * 20_000, " ".join(f"w{rng.random()}" for _ in range(80))
    rows = [(7, text), (3, text + " end"), (9, "a b " * 3000)] + [(k * 64, passage) for k in range(300)] + [(5, passage + " once more")] * 200
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    one = found(df)
    assert one == plain(rows)
    most = S.repeated_spans(df, group=16).distinct().groupBy("doc", "tag").count().agg({"count": "max"}).first()[0]
    assert most < 500


def test_a_hot_prefix_is_lengthened_word_by_word(spark):
    """Suffixes of one prefix part where their words do: at 6 to 12 words; copies of one window stay together and are dealt."""
    common = [f"c{k}" for k in range(13)]
    rows = []
    for depth in range(5, 13):
        rows += [(len(rows) + k, " ".join(common[:depth] + [f"d{depth}x{k // 6}"] + [f"e{depth}x{k // 6}y{j}" for j in range(12)])) for k in range(60)]
    rows += [(10_000 + k, " ".join(common)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert found(df) == plain(rows)
    least = S.repeated_spans.__defaults__
    plain_spans = found(df)
    S.repeated_spans.__defaults__ = ("doc_id", "text", 8, S.MAP_BITS)
    try:
        assert found(df) == plain_spans
    finally:
        S.repeated_spans.__defaults__ = least
    rows = S._rows(df, "doc_id", "text").select("doc", "text")
    got = S._suffixes(rows, S.maps_of(rows, 8, 1 << 19)).filter("part <> 0")
    sizes = {r["open"]: r["most"] for r in got.groupBy("a", "part", "open").count().groupBy("open").agg({"count": "max"}).withColumnRenamed("max(count)", "most").collect()}
    assert len(sizes) >= 5 and 0 in sizes  # lengthened by 9 - open words; 0: whole windows, dealt by hash
    assert all(n <= 8 for k, n in sizes.items() if k > 0)


def test_a_text_of_megabytes(spark):
    text = " ".join(f"w{k % 7_001}" for k in range(400_000))
    rows = [(1, text), (2, "x " + " ".join(text.split()[100:140])), (0, " ".join(text.split()[500:520]))]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == plain(rows)

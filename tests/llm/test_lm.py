import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterlake.llm import lm
from meterlake.llm.bitmap import bits_for, build, contains


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</>"]


@pytest.mark.parametrize("head", [1 << 18, 40, 0])
def test_base_scores_equal_plain_counts(spark, docs, head, monkeypatch, tmp_path):
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (head,))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = docs.collect()
    counts = Counter()
    for r in rows:
        if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10:
            counts.update(tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(r["doc_id"]), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4))
        for r in rows for t in [tokens(r["text"])]
    )
    got = lm.op6_lm_score(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] <= 0 for r in got)


def test_words_are_told_apart_as_by_the_plain_pattern():
    texts = ["", " ", "A b", "b a", "Ünï ünï ЖЖ 漢字\x0bx\x1cy", "x" * 30000, "ab", "c d\n", "  lead", "tail  ", "ab c", "a bc"]
    t = lm.tokens(pa.array(["skip", *texts]).slice(1))
    got = [t.words[a:b].tolist() for a, b in zip(t.offsets, t.offsets[1:])]
    want = [tokens(x) for x in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    named = {}
    for x, y in zip(got, want):
        assert all(named.setdefault(b, a) == a for a, b in zip(x, y))
    assert len(set(named.values())) == len(named)


def test_no_training_rows(spark, docs, no_docs):
    model, counts, beyond = lm.train(no_docs.select("text"))
    assert (model.n, model.v) == (0, 0)
    assert all(r["base_score"] == 0 and r["score"] == 0 for r in lm.score(docs, model, counts, beyond).collect())
    assert lm.score(no_docs, model, counts, beyond).count() == 0


def test_levels(spark):
    n = [1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 15, 16, 1000, 10**9, 2**40, 3 * 2**40]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in n], "n bigint").select(lm._level(F.col("n"))).collect()]
    low, high = lm.level_value(np.array(got)), lm.level_value(np.array(got) + 1)
    assert (low <= n).all() and (np.array(n) < high).all() and lm.level_value(np.arange(9)).tolist() == [0, 1, 2, 3, 4, 6, 8, 12, 16]


def test_counts_come_back_by_level(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 2**63, 5000, dtype=np.int64)
    n = rng.integers(2, 3000, 5000)
    rows = spark.createDataFrame([(int(k), int(x)) for k, x in zip(keys, n)], "key bigint, n bigint").select("key", F.lit(2).alias("lo"), lm._level(F.col("n")).alias("hi"))
    level = np.array([r["hi"] for r in rows.collect()])
    bitmap = build(rows, bits_for(int(level.sum()), 1 << 28, lm.BITS_EACH), lm.PROBES, lm.HIGHER_PROBES)
    assert np.array_equal(lm.log_frequency(bitmap, keys.view(np.uint64)), lm.level_value(level))
    other = rng.integers(1, 2**63, 200_000, dtype=np.int64).view(np.uint64)
    assert (lm.log_frequency(bitmap, other) > 0).sum() == 0
    assert contains(bitmap, keys.view(np.uint64), 2, lm.PROBES).all()


def plain_scores(texts, train, gated, lengths):
    """log10 probability of each text by the formulas of the module's docstring, with plain dictionaries of words as they are."""
    floor = lambda n: max(x for x in lm.level_value(np.arange(1, 60)).tolist() if x <= n)
    words, seen, total, mass = Counter(), Counter(), Counter(), Counter()
    padded = lambda t: ["</>", "</>", *tokens(t)]
    for k in (1, 2):
        for p in map(padded, train):
            words.update(p[2:] if k == 1 else ())
            for i in range(k + 1, len(p)):
                total[tuple(p[i - k : i])] += 1
                if k == 1 or not gated or seen[(p[i - 1],), p[i]] >= 2:
                    seen[tuple(p[i - k : i]), p[i]] += 1
    for (context, _), c in seen.items():
        if c >= 2:
            mass[context] += floor(c) - 0.75
    n, v = sum(words.values()), len(words)

    def p_of(p, i):
        out = (words[p[i]] + 0.1) / (n + 0.1 * (v + 1))
        for k in [x - 1 for x in lengths]:
            context = tuple(p[i - k : i])
            if total[context] and i > k:
                c = seen[context, p[i]]
                out = (floor(c) - 0.75 if c >= 2 else 0) / total[context] + (1 - mass[context] / total[context]) * out
        return out

    return [sum(math.log10(p_of(p, i)) for i in range(2, len(p))) for t in texts for p in [padded(t)]]


@pytest.mark.parametrize("bits, head, lengths", [(lm.FILTER_BITS, 1 << 18, (2, 3)), (lm.FILTER_BITS, 0, (2,)), (1 << 19, 300, (2, 3)), (1 << 19, 300, (2,))])
def test_scores_equal_plain_ones_with_a_filter_that_is_large_enough_and_one_that_is_not(spark, bits, head, lengths, monkeypatch):
    rng = np.random.default_rng(6)
    known = [f"w{k}" for k in range(400)]
    p = 1 / np.arange(1, 401)
    texts = [" ".join(rng.choice(known, rng.integers(0, 300), p=p / p.sum())) for _ in range(120)]
    if bits < lm.FILTER_BITS:
        monkeypatch.setattr(lm, "BITS_EACH", 4000)  # so that these few n-grams are too many
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (head,))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "never w1 Seen W2 here", ""])], "doc_id int, text string").repartition(3)
    model, counts, beyond = lm.train(docs.filter("doc_id < 100").select("text"), bits, lengths)
    assert (model.orders[2].least > lm.LEAST) == (bits < lm.FILTER_BITS) == (beyond[lengths[-1]][1].count() > 0)
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, model, counts, beyond).collect()}
    want = plain_scores([*texts, "never w1 seen w2 here", ""], texts[:100], bits == lm.FILTER_BITS, lengths)
    assert np.allclose([got[i] for i in range(len(want))], want, rtol=1e-6)


def test_probabilities_of_all_words_sum_to_one(spark):
    """Sums over the whole vocabulary and one unseen word, in contexts from the rarest to the most common."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(lm.text_of("text").alias("text"))
    model, counts, _ = lm.train(docs)
    vocabulary = {}
    for r in docs.collect():
        vocabulary.update(dict.fromkeys(tokens(r["text"])[:-1]))
    vocabulary = [*vocabulary, "not-a-word-of-these"]
    exact = {r["key"]: r["n"] for r in counts.collect()}
    each = lm.tokens(pa.array(vocabulary))
    n = np.array([exact.get(int(k.view(np.int64)), 0) for k in lm.word_keys(each.words)])[::2]
    end = exact[int(lm.word_keys(each.words[1:2]).view(np.int64)[0])]
    order = np.argsort(n[:-1], kind="stable")
    for v in [vocabulary[i] for i in order[np.linspace(0, len(order) - 1, 12).astype(int)]]:
        total = 0.0
        for k in range(0, len(vocabulary), 20_000):
            some = vocabulary[k : k + 20_000]
            t = lm.tokens(pa.array([f"{v} {w}" for w in some]))
            found = model.parts(t)[2]
            second = t.offsets[:-1] + 1
            assert not found["context"][second].any()  # all words are in the head here
            total += (found["part"][second] + found["left"][second] * (n[k : k + 20_000] + 0.1) / model.whole).sum()
        t = lm.tokens(pa.array([v]))
        found = model.parts(t)[2]
        total += found["part"][1] + found["left"][1] * (end + 0.1) / model.whole
        assert abs(total - 1) < 0.01, (v, total)


def test_model_beats_the_base_on_held_out_rows(spark):
    got = lm.op6_lm_score(spark, "/root/testdata/sf0.01").toPandas()
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


@pytest.mark.parametrize("size, head", [("sf0.001", 1 << 18), ("sf0.001", 500), ("sf0.01", 5000)])
def test_scores_equal_a_plain_model_whatever_the_size(spark, size, head, monkeypatch):
    """No context shares its numbers with another, however many there are."""
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (head,))
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", lm.text_of("text").alias("text"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model, counts, tables = lm.train(docs.filter("doc_id % 10 > 0").select("text"))
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, model, counts, tables).collect()}
    want = plain_scores([t for _, t in rows], [t for i, t in rows if i % 10], True, (2,))
    off = np.abs(np.array([got[i] for i, _ in rows]) / np.array(want) - 1)  # a probe in 4,000 finds a level too high
    assert off.max() < 2e-3 and off.mean() < 2e-5 and np.mean(off > 1e-9) < 0.2


def test_totals_of_contexts_are_counts_of_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(lm.text_of("text").alias("text"))
    _, counts, tables = lm.train(docs)
    met = tables[2][0].join(counts.withColumn("context", F.shiftrightunsigned("key", 16)), "context")
    of, more, once = met.agg(F.count(F.lit(1)), F.count_if(F.col("total") != F.col("n")), F.count_if((F.col("left") < 0) | (F.col("left") >= 1))).first()
    assert of > 50_000 and more == 0 and once == 0


def test_the_query_scores_with_triples(spark):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r["doc_id"]: (r["score"], r["held_out"]) for r in lm.op6_lm_score(spark, "/root/testdata/sf0.001").collect()}
    train = [t for i, t in rows if not got[i][1]]
    off = np.abs(np.array([got[i][0] for i, _ in rows]) / np.array(plain_scores([t for _, t in rows], train, True, (2, 3))) - 1)
    assert off.max() < 2e-3 and off.mean() < 2e-5


def test_contexts_of_triples_are_at_hand_and_rare_ones_are_joined(spark, monkeypatch):
    """Whether contexts are broadcast or joined, and their followers meet in one part or in several, no score changes."""
    rng = np.random.default_rng(7)
    p = 1 / np.arange(1, 61)
    texts = [" ".join(f"w{k}" for k in rng.choice(60, rng.integers(0, 200), p=p / p.sum())) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    want = plain_scores(texts, texts[:60], True, (2, 3))
    for most, chars, spread in ((1 << 21, 1 << 23, 128), (40, 1 << 23, 128), (40, 2000, 5)):
        for name, value in (("CONTEXTS", most), ("PART_CHARS", chars), ("SPREAD", spread), ("FLUSH", 2000), ("SLICE", 4000)):
            monkeypatch.setattr(lm, name, value)
        model, counts, tables = lm.train(docs.filter("doc_id < 60").select("text"), lengths=(2, 3))
        found = model.parts(lm.tokens(pa.array(texts)))
        assert (found[3]["left"] < 1).any()
        assert found[3]["context"].any() == found[2]["context"].any() == (most == 40)
        got = {r["doc_id"]: r["score"] for r in lm.score(docs, model, counts, tables).collect()}
        assert np.allclose([got[i] for i in range(len(want))], want, rtol=1e-6)
        totals = tables[3][0].agg(F.count(F.lit(1)), F.countDistinct("context")).first()
        assert totals[0] == totals[1] > 40


@pytest.mark.parametrize("flush, part, hot", [(1 << 20, 1 << 23, 1 << 14), (1500, 700, 40), (1, 300, 4), (3000, 300, 1 << 30)])
def test_what_parts_answer_equals_a_plain_model(spark, flush, part, hot, monkeypatch):
    """However many runs ask however many parts, and whichever contexts are dealt to all parts; texts held out, empty, with words and pairs of their own."""
    rng = np.random.default_rng(8)
    p = 1 / np.arange(1, 201)
    texts = [" ".join(f"w{k}" for k in rng.choice(200, rng.integers(0, 200), p=p / p.sum())) for _ in range(120)]
    texts = [*texts, "never W1 seen W2 here w1 w1", "", " \n", "w1", "alone", *["the same text again and again"] * 3]
    for name, value in (("FLUSH", flush), ("PART", part), ("HOT", hot), ("PIECE", part // 3), ("SLICE", 1000), ("HIGHER_PROBES", 20), ("HIGHER_BITS", 29)):
        monkeypatch.setattr(lm, name, value)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    train = [t for i, t in enumerate(texts) if i % 4]
    for lengths in ((2, 3), (2,), (3,), (2, 3, 4)) if flush == 1500 else ((2, 3),):
        found, n = lm.scored(docs, F.col("doc_id") % 4 > 0, lengths)
        got = {r["doc_id"]: r for r in found.collect()}
        assert n == sum(len(tokens(t)) for t in train) and sorted(got) == list(range(len(texts)))
        assert [got[i]["n_tokens"] for i in range(len(texts))] == [len(tokens(t)) for t in texts]
        if lengths != (2, 3, 4):
            assert np.allclose([got[i]["score"] for i in range(len(texts))], plain_scores([t.lower() for t in texts], train, True, lengths), rtol=1e-9)
        else:
            more = [got[i]["score"] for i in range(len(texts))]
            assert max(more) <= 0 and np.isfinite(more).all()


def test_the_query_sends_no_model_to_all_tasks(spark, monkeypatch):
    """Neither a filter nor tables of words and contexts are broadcast or gathered: they grew until most tokens were joined one by one."""
    for name in ("build", "vocabulary", "frequent_contexts", "_looked_up"):
        monkeypatch.setattr(lm, name, None)
    assert lm.op6_lm_score(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from meterlake.llm import phrases as P

COLUMNS = "doc_id bigint, text string, lang string, key string, n string, w1 string, word string, depth string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def pieces(text):
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or ""))]


def plain(rows, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inner = Counter()
    for (lang, g), a in found.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                inner[lang, g[i : i + m]] = max(a, inner[lang, g[i : i + m]])
    out = []
    for (lang, g), a in found.items():
        if 100 * inner[lang, g] >= 80 * a:
            continue
        score, k = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
        out.append((lang, -score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    rank, ranked = Counter(), []
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(ranked)


def mined(df, **more):
    return sorted(tuple(r) for r in P.collocations(df, **more).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    common = ["The", "of", "a", "é", "漢字", "x-y", "(z)", "\x0bq", "ÀB"]
    fixed = ["New York City Hall", "as well as", "on the other hand side", "Ice cream", "a b a b a b"]
    rows = []
    for i in range(n):
        words = [rng.choice([rng.choice(common), rng.choice(fixed), rng.choice(fixed[:2]), f"rare{rng.randrange(900)}"]) for _ in range(rng.randint(0, 30))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "?!"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "en", "fr", None, "und"])))
    return rows + rows[:3] + [(7, None, "en"), (8, "", None), (9, " \t .,;", "fr"), (10, "same " * 3000, "en"), (11, "New York " * 500, "en"), (12, "z" * 500_000, "en")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *("z",) * 5) for r in rows], COLUMNS).repartition(3)


@pytest.mark.parametrize("budget", [P.BUDGET, 200, 40])
def test_equals_a_plain_count(spark, budget, monkeypatch):
    rows = corpus(1, 500)
    want = plain([r[1:] for r in rows], 12)
    assert len(want) > 60 and {r[0] for r in want} == {"en", "fr", "und"} and {len(r[2].split(" ")) for r in want} == {2, 3, 4}
    monkeypatch.setattr(P, "FLUSH", 500)
    assert mined(frame(spark, rows), least=12, budget=budget) == want


def test_first_ones_and_ties(spark):
    rows = [(i, "Aa bb. cc DD! ee ff; gg hh", "en") for i in range(40)] + [(i, "x1 x2", None) for i in range(29)]
    df = frame(spark, rows)
    want = plain([r[1:] for r in rows], 30)
    assert [r[2] for r in want] == ["aa bb", "cc dd", "ee ff", "gg hh"]
    assert mined(df) == want and mined(df, top=3) == want[:3]


def test_awkward_and_empty_tables(spark, docs, no_docs):
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert mined(docs, least=3) == plain(rows, 3)
    assert mined(docs, least=2, budget=50) == plain(rows, 2)
    assert mined(no_docs) == []


def test_words_are_those_of_the_pattern():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB .,;:!?\n\v\f\r\t\x1c é漢\U0001f600") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    w = P.words_of(pa.array(texts), pa.array(["en"] * len(texts)))
    got = P._texts(w, np.arange(len(w.keys))).to_pylist()
    want = [[x for x in pieces(t) if x] for t in texts]
    assert got == [word for t in want for piece in t for word in piece]
    assert w.joined.tolist() == [i < len(piece) - 1 for t in want for piece in t for i in range(len(piece))]
    assert len(set(w.keys.tolist())) == len(set(got)) and dict(zip(got, w.keys.tolist())) == dict(zip(got[::-1], w.keys.tolist()[::-1]))


def test_groups_fit_the_budget(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), rng.randint(1, 50)) for _ in range(3000)]
    cuts = P.group_cuts(spark.createDataFrame(rows, "key bigint, n bigint"), 500)
    sums = Counter()
    for key, n in rows:
        sums[int(np.searchsorted(cuts, np.uint64(key % (1 << 64)), side="right"))] += n
    assert max(sums.values()) <= 500 and len(sums) < 2 * sum(n for _, n in rows) / 500 + 2

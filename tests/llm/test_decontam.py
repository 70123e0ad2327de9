import random
import re

import numpy as np

from meterlake.llm.decontam import Hashes, contamination, drop_contaminated, tiles
from tests.llm.conftest import DOCS, CLASHES, words


def brute_tiles(a: list, b: list, least: int) -> list[tuple[int, int, int]]:
    used_a, used_b, found = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n >= least and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return found
        n, i, j = -best[0], best[1], best[2]
        used_a.update(range(i, i + n))
        used_b.update(range(j, j + n))
        found.append((i, j, n))


def test_tiles_equal_plain_tiling():
    rng = random.Random(2)
    hashes = Hashes()
    for _ in range(60):
        a, b = (" ".join(rng.choice("abc") for _ in range(rng.randint(0, 25))) for _ in "ab")
        got = tiles(hashes.of(a), hashes.of(b))
        assert got == brute_tiles(a.split(), b.split(), 3)


def test_tiling_is_linear_where_words_repeat():
    import time
    import tracemalloc

    hashes = Hashes()
    doc, item = hashes.of("same " * 200_000 + "other words here"), hashes.of("same " * 2_000 + "here")
    tracemalloc.start()
    began = time.perf_counter()
    got = tiles(doc, item)
    assert got == [(0, 0, 2000)] and time.perf_counter() - began < 10 and tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def brute_leaks(docs, items, least=3, coverage=0.8):
    out = {}
    for d, text in docs:
        for i, item in items:
            a, b = (re.findall(r"\w+", (t or "").lower()) for t in (text, item))
            n = sum(x[2] for x in brute_tiles(a, b, least)) if len(b) >= least else 0
            if n and n >= coverage * len(b) - 1e-9:
                out[d, i] = max(out.get((d, i), 0), n)
    return out


def test_leaks_equal_tiling_all_pairs(spark):
    """Reordered, shortened and diluted passages against every pair, with repeated words, short items, text ids and null ids."""
    rng = random.Random(12)
    few = ["a", "b", "c"]
    items = [(f"i{k}", words(rng, rng.choice([2, 3, 4, 5, 9, 12, 15]))) for k in range(25)]
    items += [("r", "x x x x x x y"), ("s", " ".join(rng.choice(few) for _ in range(12))), (None, "one two three four five six"), ("z", None), ("a1", "a1 a2 a3 a4 b1 b2 b3 b4 c1 c2 c3 c4")]
    docs = [(0, "c1 c2 c3 c4 z b1 b2 b3 b4 z a1 a2 a3 a4"), (1, "ONE two, three; four five"), (2, "x x x x q x x y"), (3, None), (4, " ".join(rng.choice(few) for _ in range(40)))]
    for k in range(60):
        w = (rng.choice(items)[1] or "").split()
        size = rng.choice([3, 3, 4, 5, 8])
        pieces = [w[i : i + size] for i in range(0, len(w), size)]
        rng.shuffle(pieces)
        if len(pieces) > 2 and rng.random() < 0.4:
            pieces.pop()
        docs.append((10 + k, " ".join(" ".join(p) + rng.choice(["", " zz", " " + words(rng, 4)]) for p in pieces)))
    table = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in contamination(table, bench).collect()}
    assert got == brute_leaks(docs, items) and (0, "a1") in got and (1, None) in got and len(got) > 20


def row(i, text):
    return (i, text, None, None, None, *("z" for _ in CLASHES))


def test_copies_moved_sentences_and_clean_texts(spark, docs, no_docs):
    rng = random.Random(9)
    items = {n: words(rng, 40) for n in range(30)}
    item = items[3].split()
    moved = " ".join(item[28:] + item[:14] + ["plus"] + item[14:28])
    made = [row(100, words(rng, 300) + " " + items[3].upper().replace(" ", ", ") + " " + words(rng, 200)), row(101, moved), row(102, " ".join(item[:20])), row(103, words(rng, 500)), row(104, items[4] + " " + items[5]), row(104, items[4] + " " + items[5]), row(None, items[6])]
    table = spark.createDataFrame(made, DOCS).unionByName(docs)
    bench = spark.createDataFrame([*items.items(), (50, None), (51, ""), (52, "two words"), (None, "x y z u v w")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contamination(table, bench).collect()}
    assert set(got) == {(100, 3), (101, 3), (104, 4), (104, 5), (None, 6)}
    assert got[101, 3]["n_tiles"] == 3 and got[101, 3]["coverage"] == 1.0
    left = [r["doc_id"] for r in drop_contaminated(table, bench).collect()]
    assert not {100, 101, 104} & set(left) and {102, 103, 1, 14} <= set(left)
    assert contamination(no_docs, bench).count() == 0
    assert contamination(table, bench.limit(0)).count() == 0


def test_every_planted_item_of_the_test_data(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: " ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = {r["item_id"]: " ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    want = {(i, j) for i, t in docs.items() for j, s in items.items() if s in t}
    got = {(r["doc_id"], r["item_id"]) for r in contamination(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert want <= got and np.isclose(len(want), len(got), atol=2)

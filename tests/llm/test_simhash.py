import random

import numpy as np
import xxhash

from meterlake.llm import simhash as S
from meterlake.llm.components import components


def plain_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def plain_groups(prints):
    """Smallest id reachable, by position; ids may be null."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(prints))]


def test_awkward_rows(spark, docs, no_docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [(r["doc_id"], plain_print(r["text"])) for r in rows]
    want = sorted(zip(map(str, (p[0] for p in prints)), (p[1] for p in prints), map(str, plain_groups(prints))))
    got = sorted((str(r["doc_id"]), r["fp"] % 2**64, str(r["component_id"])) for r in S.near_duplicates(docs).collect())
    assert got == want
    assert S.near_duplicates(no_docs).count() == 0 and S.drop_near_duplicates(no_docs).count() == 0
    left = [r["doc_id"] for r in S.drop_near_duplicates(docs).collect()]
    assert -3 in left and not {1, 2} & set(left)  # -3 is the same text in capitals


def test_links_at_every_distance_and_in_sliced_buckets(spark):
    rng = random.Random(8)
    prints = []
    for _ in range(40):
        x = rng.getrandbits(64)
        prints.append(x)
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            prints.append(x)
    prints += [7, 7 << 61, 2**64 - 1]
    nodes = sorted(set(prints))
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in nodes], "fp bigint")
    for size in (4096, 2):
        edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in S.links(df, size).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in edges)
        got = components(S.links(df, size))
        roots = {r["node"] % 2**64: r["root"] % 2**64 for r in got.collect()}
        want = plain_groups([(p, p) for p in nodes])
        same = {}
        for p, w in zip(nodes, want):
            assert same.setdefault(roots.get(p, p), w) == w
        assert len(same) == len(set(want))


def test_components_of_paths_hubs_and_noise(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(200)] + [(5000, 5000), (None, 3), (2000, 1500), (2000, 1500)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 200)}, 2000: 1500}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_long_text_equals_plain():
    text = " ".join(str(i % 977) for i in range(70000))
    assert S.fingerprint(text) == plain_print(text)

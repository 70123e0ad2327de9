import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from meterlake.llm.packing import encoder

import corpus_pipeline as P
from tests.llm.test_decontam import brute_tiles

D = "/root/testdata/sf0.001"
#: Pattern, group that counts, least length.
BASE = (
    (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("AKIA[A-Z0-9]+", 0, 18),
    ("[0-9a-f]+", 0, 16),
)


def plain_representatives(texts):
    """The smallest id of each group of texts linked by a Jaccard similarity of 0.8 or more of their sets of five-word shingles."""
    sets = {}
    for i, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = {i: i for i in sets}
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {x: new if g == old else g for x, g in group.items()}
    return set(group.values())


def plain_leaks(texts, items):
    """Documents whose tiles cover 0.8 of an item; pairs that share fewer words than that are not tiled."""
    out = set()
    bags = {i: (re.findall(r"\w+", t.lower()), Counter(re.findall(r"\w+", t.lower()))) for i, t in texts.items()}
    for item in items:
        w = re.findall(r"\w+", (item or "").lower())
        for i, (words, bag) in bags.items():
            if i not in out and len(w) >= 3 and (Counter(w) & bag).total() >= 0.8 * len(w):
                known = set(w)
                short = [x if x in known else None for x in words]  # words that the item lacks end any tile
                short = [x for k, x in enumerate(short) if x or (k and short[k - 1])]
                if sum(x[2] for x in brute_tiles(short, w, 3)) >= 0.8 * len(w):
                    out.add(i)
    return out


def test_stages_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    first = P.quality(spark, docs, D)
    assert first.columns == docs.columns
    rows = {r["doc_id"]: r for r in first.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    judged = [(labels[i], i in rows) for i in {r["doc_id"] for r in docs.collect()} if i in labels]
    assert sum(bool(q) == k for q, k in judged) / len(judged) > 0.95

    keep = plain_representatives({i: r["text"] for i, r in rows.items()})
    second = spark.createDataFrame(P.near_dedup(spark, spark.createDataFrame(list(rows.values()), docs.schema), D).collect(), docs.schema)
    assert {r["doc_id"] for r in second.collect()} == keep

    leaks = plain_leaks({r["doc_id"]: r["text"] for r in second.collect()}, [r["text"] for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()])
    third = P.decontaminate(spark, second, D).collect()
    assert {r["doc_id"] for r in third} == keep - leaks and leaks

    fourth = P.secrets(spark, spark.createDataFrame(third, docs.schema), D).collect()
    changed = 0
    for a, b in zip(sorted(third), sorted(fourth)):
        assert b["n_chars"] == len(b["text"]) and a["doc_id"] == b["doc_id"]
        if not any(len(m[g]) >= n for p, g, n in BASE for m in re.finditer(p, a["text"])) and not re.search("[=:]", a["text"]):
            assert a["text"] == b["text"]
        at = 0
        for piece in b["text"].split("[secret]"):  # what is left stands in its order
            assert (at := a["text"].find(piece, at)) >= 0
            at += len(piece)
        assert not any(len(m[g]) >= n and "[secret]" not in m[0] for p, g, n in BASE for m in re.finditer(p, b["text"]))
        changed += a["text"] != b["text"]
    assert changed

    encode, got = encoder(), defaultdict(int)
    for r in P.run(spark, D).collect():
        got[r["doc_id"]] += r["length"]
    assert got == {r["doc_id"]: len(encode(r["text"])) + 1 for r in fourth}


def test_no_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{D}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_null_texts_pass(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, "t " * 80, None, None, None), (2, "", None, None, 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() > 0


def test_stages_that_drop_rows_move_no_texts(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for stage in (P.near_dedup, P.decontaminate):
        plan = stage(spark, docs, D)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert not any("Exchange" in line and "text" in line for line in plan.splitlines())


def test_awkward_rows_pass_through_every_stage(spark, tmp_path):
    """A null id, a text of megabytes, and columns whose names clash with inner ones."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    extra = {c: F.lit("z") for c in ("id", "row", "fp", "key", "tag", "words", "rep", "root", "n", "gone", "__gone")}
    prose = " ".join(docs.filter("doc_id = 1").first()["text"].split())
    own = " ".join(f"{w}{k}" for k in range(300) for w in prose.split()[:60]) + ". "
    more = spark.createDataFrame([(None, own * 20, "en", "s", 0), (10**12, None, "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    now = docs.unionByName(more).withColumns(extra)
    for name, stage in P.STAGES[1:4]:
        now = stage(spark, now, D)
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        now = now.withColumns(extra)
    now.write.parquet(str(tmp_path / "kept"))
    now = spark.read.parquet(str(tmp_path / "kept"))
    found = {r["doc_id"]: r["text"] for r in now.collect()}
    assert len(found[None]) > 2_000_000
    pieces = P.packing(spark, now, D).filter("doc_id IS NULL").collect()
    assert sum(r["length"] for r in pieces) == len(encoder()(found[None])) + 1

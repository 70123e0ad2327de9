import random
from contextlib import contextmanager

import pytest

from meterlake.llm import lines as L
from meterlake.llm import lookup


@contextmanager
def settings(spark, **values):
    names = {"parts": "spark.sql.shuffle.partitions", "coalesce": "spark.sql.adaptive.coalescePartitions.enabled", "batch": "spark.sql.execution.arrow.maxRecordsPerBatch"}
    before = {k: spark.conf.get(names[k]) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    yield
    for k, v in before.items():
        spark.conf.set(names[k], v)


def plain(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    least = float("-inf")
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(least if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == (least if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in L.drop_lines(df).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    shared = [f"shared line number {k:03d} " + "é漢"[k % 2] * 20 for k in range(40)]
    hot = "This Line is nearly Everywhere, in one of three documents."
    rows = []
    for i in range(n):
        lines = [rng.choice([f"own {i} " + "x" * rng.randint(0, 60), "short", "", " \t", "  " + rng.choice(shared).upper() + "\r", rng.choice(shared[:8])]) for _ in range(rng.randint(0, 12))]
        lines += [hot] * rng.choice([0, 0, 1, 3])
        rng.shuffle(lines)
        rows.append((rng.choice([i, i, i, None, i // 3]), "\n".join(lines)))
    return rows + rows[:5] + [(7, None), (8, ""), (9, "\n"), (10, (hot + "\n") * 2000), (11, "y" * 2_000_000 + "\n" + hot), (12, "z" * 39), (13, " " * 100)]


@pytest.mark.parametrize("parts, batch", [("2", "10000"), ("13", "5")])
def test_equals_a_plain_search(spark, docs, parts, batch):
    rows = corpus(int(parts), 400)
    want = plain(rows)
    assert sum(r[2] for r in want) > 1000
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    with settings(spark, parts=parts, coalesce="false", batch=batch):
        assert found(df) == want
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert found(docs) == plain(rows)


def test_a_line_that_spans_partitions(spark):
    line = "q" * 40
    rows = [(i, f"{line}\n{i}") for i in range(900)]
    for n in (4, 5, 900):
        with settings(spark, parts="8", coalesce="false", batch="11"):
            df = spark.createDataFrame(rows[:n], "doc_id bigint, text string")
            got = {r["doc_id"]: r["n_dropped"] for r in L.drop_lines(df).collect()}
        assert got == {i: int(n >= 5 and i != n - 1) for i in range(n)}


def test_bitmaps_are_small_and_read_back(spark):
    rows = [(i, "\n".join(["a" * 40, "b", "c" * 50, "", str(i)])) for i in range(6)]
    got = L.keep_bitmaps(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["doc"] for r in got) == list(range(5))
    assert all(L.kept_lines(bytes(r["bitmap"]), 5).tolist() == [False, True, False, True, True] for r in got)
    assert L.kept_lines(None, 3).all() and L.keep_bitmaps(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_empty_table(spark, no_docs):
    assert found(no_docs) == []


def test_lookups_are_the_same_by_broadcast_and_by_filter(spark):
    rows = spark.createDataFrame([(i if i % 11 else None, f"t{i}") for i in range(200)], "k bigint, text string")
    small = spark.createDataFrame([(i, f"s{i}") for i in range(0, 400, 7)], "k bigint, more string")
    for most in (lookup.BROADCAST_BYTES, 0):
        met = sorted(((r["k"], r["text"], r["more"]) for r in lookup.attach(rows, small, ["k"], most).collect()), key=str)
        assert met == sorted(((i if i % 11 else None, f"t{i}", f"s{i}" if i % 11 and i % 7 == 0 else None) for i in range(200)), key=str)
        left = lookup.without(rows, small.select("k"), "k", most)
        assert left.columns == rows.columns
        assert sorted(r["text"] for r in left.collect()) == sorted(f"t{i}" for i in range(200) if i % 11 == 0 or i % 7)


def test_few_dropped_lines_do_not_shuffle_texts(spark):
    df = spark.createDataFrame([(i, f"{'w' * 60}\n{i}") for i in range(50)], "doc_id bigint, text string")
    plan = L.drop_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan

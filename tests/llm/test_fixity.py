import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from meterlake.llm import fixity as X

PAGES = "page_id bigint, url string, html string, offset bigint, node bigint, sha256 string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 9, 9, "z") for r in rows], PAGES)


def records(df):
    return sorted(((r["archive_id"], str(r["page_id"]), r["offset"], r["length"], bytes(r["sha256"]).hex()) for r in X.index_of(df).collect()))


def test_records_are_laid_one_after_another(spark):
    df = pages(spark, [(1, "u", "<p>é"), (0, None, None), (1, "u", "<p>é"), (None, "v", ""), (1500, "w", "x" * 100000)])
    got = records(df)
    assert [g[0] for g in got] == [-1, 0, 0, 0, 1]
    text = "\r\n".join(
        ["WARC/1.1", "WARC-Type: response", "WARC-Record-ID: <urn:uuid:c4ca4238-a0b9-2382-0dcc-509a6f75849b>", "WARC-Target-URI: u",
         "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: text/html", "Content-Length: 5", "", "<p>é", "", ""]
    ).encode()
    one = [g for g in got if g[1] == "1"]
    assert [g[4] for g in one] == [hashlib.sha256(text).hexdigest()] * 2
    assert one[0][3] == len(text) and one[1][2] == one[0][2] + len(text)


def test_audit_finds_exactly_what_differs(spark):
    rows = [(i, f"http://h/{i}", "<p>" + "x" * (i * 37 % 900)) for i in range(2300)]
    index = X.index_of(pages(spark, rows))
    other = X.index_of(pages(spark, [(i, u, h[:-1] + "!" if i in (7, 1999, 2299) else h) for i, u, h in rows])).filter("page_id NOT IN (500, 2298)")
    got = {r["page_id"]: r["status"] for r in X.audit(index, other).collect()}
    assert got == {7: "corrupt", 1999: "corrupt", 2299: "corrupt", 500: "missing", 2298: "missing"}
    back = {r["page_id"]: r["status"] for r in X.audit(other, index).collect()}
    assert back[500] == "extra" and back[7] == "corrupt"
    assert X.audit(index, index).count() == 0
    none = index.limit(0)
    assert X.audit(index, none).count() == 2300 and X.audit(none, none).count() == 0


def test_losses_and_additions_before_indexing_equal_plain_counts(spark):
    rng = random.Random(21)
    rows = [(i, f"http://h/{i}", "<p>" + "x" * rng.randint(0, 900)) for i in range(2300)]
    rows += [(None, f"n{i}", "y") for i in range(40)] + [(44, "http://h/44", "again")] * 3 + [(None, "same", "z")] * 30
    other = []
    for i, u, h in rows:
        fate = rng.random()
        if fate < 0.01:
            continue
        other.append((i, u, h[:-1] + "!" if 0.01 <= fate < 0.02 else h[: len(h) // 2] if fate < 0.03 else h))
        if fate > 0.99:
            other.append((rng.choice([5000, None, i]), u, h))
    got = X.audit(X.index_of(pages(spark, rows)), X.index_of(pages(spark, other))).collect()
    digest = lambda r: (r[0], r[1], r[2])
    a, b = Counter(map(digest, rows)), Counter(map(digest, other))
    lost, new = a - b, b - a
    want = Counter()
    for i in {x[0] for x in [*lost, *new]}:
        x, y = [n for k, n in lost.items() if k[0] == i], [n for k, n in new.items() if k[0] == i]
        both = 0 if i is None else min(len(x), len(y))
        want[str(i), "corrupt"] += both
        want[str(i), "missing"] += len(x) - both
        want[str(i), "extra"] += len(y) - both
    assert Counter((str(r["page_id"]), r["status"]) for r in got) == +want
    assert sum(r["copies"] for r in got if r["page_id"] is None and r["status"] == "missing") == sum(n for k, n in lost.items() if k[0] is None)


def test_one_lost_record_is_one_row(spark):
    rows = [(i, f"http://h/{i}", "x" * (i * 37 % 900)) for i in range(1000)]
    got = X.audit(X.index_of(pages(spark, rows)), X.index_of(pages(spark, rows[:3] + rows[4:]))).collect()
    assert [(r["page_id"], r["status"], r["copies"]) for r in got] == [(3, "missing", 1)]


def test_roots_cover_every_record(spark):
    index = X.index_of(pages(spark, [(i, "u", "y" * 5000) for i in range(300)]))
    root = lambda index: X.trees(index, index).roots.filter("side = 0").first()
    top = root(index)
    assert top["size"] == index.agg({"length": "sum"}).first()[0]
    assert root(index.withColumn("offset", index["offset"] + 1))["hash"] == top["hash"]  # moved as a whole
    assert root(index.withColumn("sha256", F.when(F.col("page_id") == 7, F.lit(b"x")).otherwise(F.col("sha256"))))["hash"] != top["hash"]


def test_one_lost_record_is_found_by_a_few_nodes(spark):
    rng = random.Random(5)
    rows = [(i, f"http://h/{i}", "x" * rng.randint(0, 900)) for i in range(6000)]
    one = X.index_of(pages(spark, rows))
    for gone in (3, 2500, 5999):
        seen = {r["level"]: r for r in X.visits(one, X.index_of(pages(spark, rows[:gone] + rows[gone + 1 :]))).collect()}
        assert seen[max(seen)]["differing"] == 2  # the archive's root on either side
        assert all(r["differing"] <= 6 and r["visited"] <= 160 for n, r in seen.items() if n < max(seen)), seen
        assert seen[1]["nodes"] > 600 and seen[1]["differing"] <= 4


def test_few_leaves_differ_in_the_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    other = X.damaged(table).filter(~F.coalesce(X._mark(F.col("page_id")) == "a1", F.lit(False)))
    seen = {r["level"]: r for r in X.visits(X.index_of(table), X.index_of(other)).collect()}
    assert seen[1]["differing"] < 0.25 * seen[1]["nodes"], seen


def test_hundreds_of_differences_equal_plain_counts(spark):
    """Ids with many versions, equal records in long runs, and records that come and go."""
    rng = random.Random(8)
    rows = [(i % 1500, f"v{i // 1500}", "x" * (i % 7)) for i in range(4500)] + [(77, f"w{k}", "") for k in range(300)] + [(5, "same", "same")] * 2500 + [(None, "n", "z")] * 200
    other = [(i, u, h + "!" if rng.random() < 0.06 else h) for i, u, h in rows if rng.random() > 0.05] + [(3000 + k, "new", "") for k in range(40)] + [(5, "same", "same")] * 150
    got = X.audit(X.index_of(pages(spark, rows)), X.index_of(pages(spark, other))).collect()
    a, b = Counter(rows), Counter(other)
    lost, new = a - b, b - a
    want = Counter()
    for i in {x[0] for x in [*lost, *new]}:
        x, y = sum(k[0] == i for k in lost), sum(k[0] == i for k in new)
        both = 0 if i is None else min(x, y)
        want.update({(str(i), "corrupt"): both, (str(i), "missing"): x - both, (str(i), "extra"): y - both})
    assert Counter((str(r["page_id"]), r["status"]) for r in got) == +want and len(got) > 400
    missing = sum(r["copies"] for r in got if r["page_id"] == 5 and r["status"] != "extra")
    assert missing >= lost[5, "same", "same"]


def test_ranges_are_bounded_and_sums_run_over_parts(spark):
    same = [(1, "u", "same")] * 5000
    index = X.index_of(pages(spark, same)).repartition(3)
    sizes = [r["count"] for r in index.groupBy("leaf").count().collect()]
    assert max(sizes) <= X.MOST and sum(sizes) == 5000
    rows = spark.createDataFrame([(k % 3, k) for k in range(500)], "k int, v int").repartition(7)
    got = X.running(rows, ["k"], [F.col("v")], {"n": F.lit(1), "s": F.col("v")}).collect()
    assert all(r["n"] == r["v"] // 3 and r["s"] == sum(range(r["k"], r["v"], 3)) for r in got) and len(got) == 500


def test_columns_with_clashing_names(spark):
    df = pages(spark, [(1, "u", "a"), (2, "v", "b")])
    more = df.selectExpr("*", *(f"'z' as {c}" for c in ("archive_id", "leaf", "hash", "size", "at", "side", "rank", "above", "length", "ordinal", "cuts")))
    assert records(more) == records(df)

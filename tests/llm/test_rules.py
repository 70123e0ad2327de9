import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meterlake.llm import rules as R


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_of_awkward_rows(spark, docs, no_docs):
    more = spark.createDataFrame([(70, "a b a b a b c"), (71, "# * $\n\n# * $\n \n|<>&%"), (72, "a a a a"), (73, "x y z x y z"), (74, "a\x0bb\x0cc\x85d\xa0e")], "doc_id bigint, text string")
    table = docs.select("doc_id", "text").union(more)
    want = sorted(str((r["doc_id"], *plain(r["text"]))) for r in table.collect())
    got = sorted(str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in R.statistics(table).collect())
    assert got == want
    assert R.statistics(no_docs).count() == 0 and R.cascade(no_docs).count() == 0


def test_order_changes_no_verdict(spark, docs):
    rules = R.text_rules(F.coalesce(F.col("text"), F.lit("")))
    one = docs.select("doc_id", R.verdict(rules).alias("k")).collect()
    other = docs.select("doc_id", R.verdict(rules[::-1]).alias("k")).collect()
    assert sorted(map(str, one)) == sorted(map(str, other))
    assert R.cascade(docs).columns == docs.columns  # its verdict takes the place of a column of that name


def test_estimates_put_cheap_strong_rules_first(spark):
    df = spark.range(4000).withColumn("text", F.repeat(F.lit("word "), 200))
    slow = R.Rule("slow", F.col("id") % 4 == 1, F.lit(100))
    quick = R.Rule("quick", F.col("id") % 2 == 0, F.lit(1))
    got = R.estimate(df, [slow, quick])
    assert [(r.name, r.reached, r.rejected, r.cost) for r in got] == [("quick", 4000, 2000, 4000.0), ("slow", 2000, 1000, 200_000.0)]
    assert R.estimate(df.limit(0), [slow, quick])[0].name == "slow"


def test_a_rule_counts_for_what_earlier_ones_leave(spark):
    df = spark.range(1000)
    wide = R.Rule("wide", F.col("id") < 600, F.lit(10))
    inside = R.Rule("inside", F.col("id") < 590, F.lit(12))  # second best alone, of no use after the first
    other = R.Rule("other", F.col("id") >= 900, F.lit(10))
    assert [r.name for r in R.estimate(df, [inside, other, wide])] == ["wide", "other", "inside"]


def test_costs_come_from_the_sample(spark):
    """Of two rules that reject as many rows the slower one comes later, whatever the given order, with no figure set by hand."""
    df = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 9973}" for k in range(1500))) for i in range(400)], "id int, text string").repartition(4)
    quick = R.Rule("quick", (F.col("id") % 4 == 0) & (F.length("text") > 0))
    slow = R.Rule("slow", (R.repeated_words(R.words_of(F.col("text"))) >= 0) & (F.col("id") % 4 == 1))
    for rules in ([slow, quick], [quick, slow]):
        got = R.estimate(df, rules)
        assert [(r.name, r.reached, r.rejected) for r in got] == [("quick", 400, 100), ("slow", 300, 100)]
        assert got[0].cost < got[1].cost
    better = R.Rule("slow", (R.repeated_words(R.words_of(F.col("text"))) >= 0) & (F.col("id") != 4))  # slow, but it rejects nearly all
    rare = R.Rule("quick", (F.col("id") == 4) & (F.length("text") > 0))
    assert R.estimate(df, [rare, better])[0].cost >= 0 and {r.name for r in R.estimate(df, [rare, better])} == {"quick", "slow"}


def test_measured_orders_hold_all_rules_and_give_one_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("text", R.text_of("text"))
    rules = R.text_rules(F.col("text"))
    order = R.estimate(docs, rules)
    assert {r.name for r in order} == {r.name for r in rules} and order[0].reached == docs.count() and all(a.reached - a.rejected == b.reached for a, b in zip(order, order[1:]))
    one, other = (docs.select("doc_id", R.verdict(r).alias("k")) for r in (order, rules))
    assert one.exceptAll(other).count() == 0


def test_a_text_of_megabytes(spark):
    text = " ".join(f"w{k % 70_001}" for k in range(300_000)) + "\n# $"
    got = R.statistics(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == plain(text)


def test_later_rules_see_only_what_earlier_ones_leave(spark):
    """The second rule fails the job wherever it is evaluated on a row that the first rejects."""
    df = spark.range(1000).withColumn("text", F.repeat(F.lit("word "), 100))
    first = R.Rule("first", F.col("id") % 3 == 0, F.lit(1))
    trap = R.Rule("trap", F.when(F.col("id") % 3 == 0, F.raise_error(F.lit("evaluated")).cast("boolean")).otherwise(F.col("id") == 1), F.lit(1))
    assert df.withColumn("kept", R.verdict([first, trap])).filter("kept").count() == 1000 - 334 - 1
    with pytest.raises(Exception, match="evaluated"):
        df.withColumn("kept", R.verdict([trap, first])).filter("kept").count()


def test_rules_over_texts_equal_rules_over_figures(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(docs.select("doc_id", "text")).withColumn("text", R.text_of("text"))
    table = table.union(spark.createDataFrame([(-9, "AB   " * 60)], "doc_id bigint, text string"))
    a = table.select("doc_id", R.verdict(R.text_rules(F.col("text"))).alias("k"))
    found = R.statistics(table, keep_text=True)
    b = found.select("doc_id", R.verdict(R.rules_over(R.figures_of(F.col("text")) | {c: F.col(c) for c in R.STATISTICS})).alias("k"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_main_path_has_no_python(spark):
    plan = R.op10_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

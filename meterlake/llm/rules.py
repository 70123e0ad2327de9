"""Quality rules as a short-circuit cascade, with DataFrame functions only.

A rule is a Boolean expression over one text. Its cost and its selectivity are measured on a sample, which is written once: each rule is run over it by itself
a few times, and its least time beyond that of a run without any rule is its cost; one aggregation tells, for each set of rules that reject a row together, how many rows
there are. From that the cascade takes rule after rule, each time the one with the most
rejections per cost among the rows that no earlier rule has rejected. The rules become one nested CASE expression, which
Spark evaluates left to right and leaves at the first rejecting rule, so a later rule's figures are never computed for
rejected rows. Order changes cost, never the verdict. Times are rounded to powers of two, so that only real differences change the order; where a rule comes
with an expression for its ``work``, that is summed over the rows instead of a time.

Statistics (words are runs of characters outside ASCII white space):
``n_words``; ``word_chars``, code points in words; ``n_symbols``, characters of
``#*$%&|<>``; ``n_dup_lines``, lines with a word that equal an earlier line;
``n_repeat_words``, words inside 3-word windows that occur twice or more in the text.

Defined results: null text is read as empty; an empty text has zeros everywhere and
fails the base rules; a null id stays null; repeated rows are judged each; an empty
table gives no rows (and the given order of rules); other columns are ignored by
``statistics`` and kept by ``cascade``, whose ``kept`` replaces one of that name. All work is inside a row, so no key or group
can be hot.
"""

from __future__ import annotations

import math
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.shared import SPACE, materialize, text_of
from meterlake.sources.tables import table

#: Rows that the cost and selectivity of rules are estimated on, about.
SAMPLE_ROWS = 1000
#: Runs of a rule over the sample, and the least time that counts, in seconds.
RUNS, SHORTEST = 2, 1 / 256
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.concat_ws("", words)).cast("long")


def symbol_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"(?!{SPACE})[\\s\\S]"))
    return F.aggregate(F.array(lines), F.lit(0), lambda _, a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, each word once.

    Windows are compared by their 64-bit hashes. Only where some repeat are they sorted with their positions, so that equal ones are
    neighbours; most texts are done before that.
    """

    def covered(sorted_windows: Column) -> Column:
        twice = F.filter(
            sorted_windows,
            lambda x, i: (x["h"] == F.get(sorted_windows, i - 1)["h"]) | (x["h"] == F.get(sorted_windows, i + 1)["h"]),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def hashes(w: Column) -> Column:
        return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.size(w) - 2)

    def repeats(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, covered))

    # let: a lambda's variable is evaluated once, an expression named twice would be evaluated for each element
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(words, lambda w: let(hashes(w), repeats))).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document with the five statistics, and with ``text`` where asked for."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    words = rows.select("id", "text", words_of(F.col("text")).alias("words"))
    return words.select(
        F.col("id").alias(id_col),
        word_count(F.col("words")).alias("n_words"),
        word_chars(F.col("words")).alias("word_chars"),
        symbol_count(F.col("text")).alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        *(["text"] if keep_text else []),
    )


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true on rows to drop (null counts as not); it names columns, as it is run on a sample too. ``work``: steps that it takes on a row, where they are known.

    Of the sample: ``reached``, rows that no earlier rule rejects; ``rejected``, those of them that this one does; ``cost``, of this rule on the rows that reach it.
    """

    name: str
    rejects: Column
    work: Column | None = None
    reached: int = 0
    rejected: int = 0
    cost: float = 0.0


def measured(sample: DataFrame, rules: Sequence[Rule], runs: int = RUNS) -> list[float]:
    """Seconds of each rule on the rows of ``sample``: the least of ``runs``, less what a run without a rule takes, to powers of two."""

    def least(asked: Column) -> float:
        times = []
        for _ in range(runs):
            began = time.perf_counter()
            sample.agg(F.count_if(asked)).collect()
            times.append(time.perf_counter() - began)
        return min(times)

    texts = [c for c, kind in sample.dtypes if kind == "string"]
    idle = least(F.length(F.concat_ws("", *texts)) >= 0 if texts else F.lit(True))
    return [2.0 ** round(math.log2(max(least(F.coalesce(r.rejects, F.lit(False))) - idle, SHORTEST))) for r in rules]


def estimate(sample: DataFrame, rules: Sequence[Rule], runs: int = RUNS) -> list[Rule]:
    """The rules in order of rejections per cost among rows that reach them; equal ones, and all without a sample, keep their order."""
    timed = [r for r in rules if r.work is None]
    if timed:
        sample = materialize(sample, "sample")
    hit = [F.coalesce(r.rejects, F.lit(False)).cast("long") * (1 << i) for i, r in enumerate(rules)]
    work = {i: r.work.cast("double").alias(f"w{i}") for i, r in enumerate(rules) if r.work is not None}
    rows = sample.select(sum(hit, F.lit(0)).alias("hits"), *work.values())
    # a row for each set of rules that reject together: 2 ** rules at most
    seen = rows.groupBy("hits").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"w{i}").alias(f"w{i}") for i in work)).collect()
    whole = max(1, sum(g["n"] for g in seen))
    seconds = dict(zip((r.name for r in timed), measured(sample, timed, runs))) if timed and seen else {}
    left, order = list(enumerate(rules)), []
    while left:
        figures = {}
        for i, r in left:
            reached, rejected = sum(g["n"] for g in seen), sum(g["n"] for g in seen if g["hits"] >> i & 1)
            cost = sum(g[f"w{i}"] or 0.0 for g in seen) if i in work else seconds.get(r.name, 0.0) * reached / whole
            figures[i] = (reached, rejected, cost)
        best, rule = max(left, key=lambda x: figures[x[0]][1] / max(figures[x[0]][2], SHORTEST))
        order.append(replace(rule, reached=figures[best][0], rejected=figures[best][1], cost=figures[best][2]))
        left = [x for x in left if x[0] != best]
        seen = [g for g in seen if not g["hits"] >> best & 1]
    return order


def verdict(rules: Sequence[Rule]) -> Column:
    """True where no rule rejects; the rules are tried in order and left at the first that does."""
    kept = F.lit(True)
    for r in reversed(rules):
        kept = F.when(F.coalesce(r.rejects, F.lit(False)), F.lit(False)).otherwise(kept)
    return kept


def sample_of(df: DataFrame, rows: int, about: int, seed: int = 7) -> DataFrame:
    """A random sample of about ``rows`` of ``about`` rows."""
    return df.sample(fraction=min(1.0, rows / max(1, about)), seed=seed)


def figures_of(text: Column) -> dict[str, Column]:
    """What the rules look at, as expressions over a text."""
    words = words_of(text)
    return {
        "n_words": word_count(words),
        "word_chars": word_chars(words),
        "n_symbols": symbol_count(text),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_words(words),
        "n_breaks": F.regexp_count(text, F.lit("\n")).cast("long"),
        "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
    }


def rules_over(f: Mapping[str, Column]) -> list[Rule]:
    """The production rules over figures, which may be columns at hand or expressions over the text. The first two are the base rules."""
    n = f["n_words"]
    return [
        Rule("few_words", n < 50),
        Rule("repeats", 100 * f["n_repeat_words"] > 50 * n),
        Rule("symbols", 10 * f["n_symbols"] > n),
        Rule("word_length", (10 * f["word_chars"] < 20 * n) | (10 * f["word_chars"] > 150 * n)),
        Rule("capitals", 100 * f["n_capitals"] > 40 * (f["word_chars"] + n)),
        Rule("repeated_lines", (f["n_dup_lines"] > 2) & (10 * f["n_dup_lines"] > 3 * (1 + f["n_breaks"]))),
    ]


def text_rules(text: Column) -> list[Rule]:
    return rules_over(figures_of(text))


def cascade(docs: DataFrame, rules: Sequence[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with a Boolean column ``kept``, by rules over the text in the order that the sample suggests."""
    rules = text_rules(text_of(text_col)) if rules is None else rules
    return docs.withColumn("kept", verdict(estimate(sample_of(docs, sample_rows, docs.count()), rules)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, the base verdict and the cascade's.

    The five statistics are asked for in every row; the cascade takes them as they are, and counts capitals and
    line breaks only in rows that get as far as the rules that look at them.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    text = F.col("text")
    order = [r.name for r in estimate(sample_of(docs, SAMPLE_ROWS, docs.count()), text_rules(text))]
    found = statistics(docs, keep_text=True)
    rules = rules_over(figures_of(text) | {c: F.col(c) for c in STATISTICS})
    base = rules[0].rejects | rules[1].rejects
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & verdict(sorted(rules, key=lambda r: order.index(r.name)))).alias("kept"),
    )


_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), pos AS (
  SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3
), win AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM pos
), twice AS (
  SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r
), f AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    length(text) - length(replace(text, chr(10), '')) AS n_breaks, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM w LEFT JOIN covered c USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
    OR 10 * word_chars < 20 * n_words OR 10 * word_chars > 150 * n_words
    OR 100 * n_capitals > 40 * (word_chars + n_words) OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * (1 + n_breaks))) AS kept
FROM f
"""

QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE_SQL = {"op10_quality_rules": _SQL}

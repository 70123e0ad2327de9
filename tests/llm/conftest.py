"""Tables with awkward rows, for the corpus operators."""

from __future__ import annotations

import random

import pytest

#: Columns whose names clash with those that operators use inside.
CLASHES = ("id", "row", "fp", "doc", "tag", "a", "b", "k", "v", "key", "n", "words", "spans", "x", "score", "kept", "lo", "hi", "component_id", "ids", "rep", "root")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


def awkward() -> list[tuple]:
    rng = random.Random(5)
    passage, base = words(rng, 60), words(rng, 120)
    texts = [
        (1, base), (2, base), (3, base + " tail"), (4, passage + " " + words(rng, 40)), (5, words(rng, 30) + "\n" + passage + "\tz"),
        (6, None), (7, ""), (8, " \n\t "), (9, "one"), (10, "one two"), (11, "Ünï çødé   x y ЖЖ 漢字 " + words(rng, 20)),
        (12, words(rng, 3000)), (13, "x" * 30000), (14, "same " * 400), (14, "same " * 400), (14, "other text under one id " + passage),
        (None, passage + " null id"), (None, None), (15, "line one\nline one\nline two\n" * 9), (16, "AKIA" + "Q" * 16 + ' password = "abcDEF123456!x" ' + "0123456789abcdef" * 2),
        (17, "<|endoftext|> </s>[INST] \\ hi"), (-3, base.upper()), (2**62, words(rng, 13)),
    ]
    return [(i, t, None if i == 3 else "en", None if i == 4 else "s", None if t is None else len(t), *("z" for _ in CLASHES)) for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

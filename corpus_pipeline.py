"""A training corpus out of ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns
of ``documents``.

1. quality: documents that the classifier scores under its threshold go.
2. near_dedup: of each group of near-duplicates (texts whose sets of five-word shingles have a
   Jaccard similarity of 0.8 or more, directly or in steps) the document with the smallest id stays. Candidates
   come from op8's SimHash fingerprints and from min-hash bands; all are compared exactly.
3. decontaminate: documents that hold a benchmark item go.
4. secrets: secrets in texts are replaced by a mark, and ``n_chars`` is counted anew.
5. packing: the documents' token ids in windows of 1024.

An input without rows gives results without rows. Null texts stay null up to the
packing, which reads them as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.decontam import drop_contaminated
from meterlake.llm.packing import pack, with_digest
from meterlake.llm.quality import keep_good
from meterlake.llm.resemblance import drop_near_copies
from meterlake.llm.secrets import redact_secrets
from meterlake.llm.shared import materialize
from meterlake.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact_secrets(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_digest(pack(docs))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]

#: Tokenizers and fingerprints have no SQL form; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

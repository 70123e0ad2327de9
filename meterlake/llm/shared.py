"""Helpers that several corpus operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlake.sources.shared import materialize, shared_dir

__all__ = ["SPACE", "materialize", "remainder", "shared_dir", "text_of"]

#: ASCII white space; words are runs of anything else.
SPACE = r"[\x20\x09-\x0D]"


def text_of(column: str | Column = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; 0 marks held-out rows. A null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)

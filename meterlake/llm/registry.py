"""Queries of the corpus operators, by name, and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and ORACLE_SQL.
MODULES = ("chat", "quality", "packing", "decontam", "secrets", "lm", "substrings", "simhash", "fixity", "rules", "lines", "phrases", "negatives")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"meterlake.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)

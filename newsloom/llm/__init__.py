"""Training-data operators: one module per operator, plus their registered queries.

Nothing outside this subpackage imports it.  Every operator module offers a general function over
DataFrames (its own column names are parameters) and a thin ``opN_<name>`` query over the given tables.
"""

from __future__ import annotations

import importlib

MODULES = ("exact_dedup", "chat_format", "byte_bpe", "language_id", "jaccard_join", "decontaminate", "secret_scan", "sharding", "license_scan", "html_extract",
           "token_counts", "lexical_search", "collocations")


def load_all() -> tuple[dict, dict]:
    """Return ``(queries, oracle_sql)`` of all operators."""
    queries: dict = {}
    oracles: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"newsloom.llm.{name}")
        queries.update(module.QUERIES)
        oracles.update(getattr(module, "ORACLE_SQL", {}))
    return queries, oracles

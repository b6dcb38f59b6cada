"""The queries of this folder and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("html_extract", "decontaminate", "chat_format", "ctw", "toxicity", "jaccard_join", "language_id", "sharding", "packing", "topk_search", "cap_filters", "clustering", "alignment")


def queries() -> dict:
    return {k: q for m in MODULES for k, q in import_module(f"newsloom.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"newsloom.llm.{m}").ORACLE_SQL.items()}

"""Queries of the text operators and the SQL twins of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ("exact_dedup", "mixing", "secrets", "quality", "ngram_join", "decontaminate", "pii", "toxicity", "lm", "substring_dedup",
           "merkle", "periodic", "html_extract")


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"fieldmark.llm.{module}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")

"""The subpackage's named queries and their SQL."""

from __future__ import annotations

import importlib

_MODULES = ("url_rules", "mixing", "packing", "pii", "licenses", "toxicity", "vptree", "hnsw", "jaccard", "suffixes")


def _loaded() -> list:
    return [importlib.import_module(f"bytewright.llm.{m}") for m in _MODULES]


def queries() -> dict:
    return {m.NAME: m.query for m in _loaded()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE_SQL for m in _loaded() if getattr(m, "ORACLE_SQL", None)}

"""Operators for building training corpora.

``queries()`` and ``oracle_sql()`` gather what the modules of this subpackage
register; nothing outside the subpackage imports it.
"""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "language_id",
    "near_dedup",
    "url_filter",
    "chat_format",
    "license_scan",
    "toxicity",
    "decontaminate",
    "mixing",
    "fingerprints",
    "token_rollups",
)


def _gather(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__name__}.{m}"), name).items()}


def queries() -> dict:
    """Query name to callable, over all modules."""
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL, where SQL can express the query."""
    return _gather("ORACLE_SQL")

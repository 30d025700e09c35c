"""All queries of this subpackage, with their SQL where there is any."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict = {}
for _name in ("cases", "conversations", "encodings", "leaks", "markup", "mixing", "near_duplicates", "overlaps", "pairs", "sentences"):
    _m = importlib.import_module(f"rankmill.llm.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL

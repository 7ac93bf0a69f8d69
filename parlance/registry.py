"""Queries over the driver's tables, and the SQL they are held against."""

from __future__ import annotations

from .plans import bindings, contracts, derived, judging, lines, records, relations, reviews, texts, turns

QUERIES: dict = {}
SQL: dict[str, str] = {}
for module in (turns, texts, relations, reviews, records, bindings, lines, judging, derived, contracts):
    QUERIES |= module.QUERIES
    SQL |= module.SQL

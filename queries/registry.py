"""All registered queries, merged from the topic modules."""

from __future__ import annotations

import importlib

from queries.inputs import expand

MODULES = ("transcript", "judging", "systems", "texts", "tables", "signals", "storage", "streams")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"queries.{_name}")
    _clash = set(QUERIES) & set(_module.QUERIES)
    if _clash:
        raise ValueError(f"duplicate query names: {sorted(_clash)}")
    QUERIES |= _module.QUERIES
    ORACLES |= {name: expand(sql) for name, sql in _module.ORACLES.items()}

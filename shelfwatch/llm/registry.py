"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["exact", "decontamination", "secrets", "sharding", "packing", "quality", "toxicity", "licenses", "near", "substrings", "filter_audit", "repair", "urls"]


def all_queries():
    return {k: v for m in MODULES for k, v in import_module(f"shelfwatch.llm.{m}").QUERIES.items()}


def all_oracles():
    return {k: v for m in MODULES for k, v in import_module(f"shelfwatch.llm.{m}").ORACLES.items()}

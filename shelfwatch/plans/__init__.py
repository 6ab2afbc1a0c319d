"""Registered queries: each module maps names to Spark callables and DuckDB SQL."""

from importlib import import_module

MODULES = [
    "price_queries", "seller_queries", "load_queries", "page_queries", "url_queries",
    "search_queries", "stream_queries", "crawl_queries",
]


def all_queries():
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def all_oracles():
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").ORACLES.items()}

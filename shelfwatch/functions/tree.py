"""Reading off a page tree: text, attributes and containment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def attr(node: Column, name: str) -> Column:
    return node["attrs"][name]


def has_attr(node: Column, name: str) -> Column:
    return F.map_contains_key(node["attrs"], name)


def attr_tokens(node: Column, name: str) -> Column:
    """A space-separated attribute as an array."""
    return F.split(F.coalesce(attr(node, name), F.lit("")), r"\s+")


def subtree_text(tree: Column, node: Column, separator: str = " ") -> Column:
    """Text pieces inside an element, joined."""
    count = node["last_text"] - node["first_text"]
    return F.array_join(F.slice(tree["texts"], node["first_text"] + 1, count), separator)


def page_text(tree: Column) -> Column:
    return F.array_join(tree["texts"], " ")


def inside(node: Column, outer: Column) -> Column:
    """``node`` is a descendant of ``outer`` (ids count in document order)."""
    return (node["id"] > outer["id"]) & (node["id"] <= outer["end"])


def nodes_where(tree: Column, condition) -> Column:
    return F.filter(tree["nodes"], condition)


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def first_filled(*arrays: Column) -> Column:
    """The first array that is not empty. Later ones are evaluated only if needed."""
    filled = [F.get(F.filter(F.array(a), lambda x: F.size(x) > 0), F.lit(0)) for a in arrays]
    return F.coalesce(*filled)

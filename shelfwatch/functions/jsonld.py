"""Dynamic JSON inside pages, held as VARIANT.

Values keep their JSON type here: a number is never taken for a string.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let
from .prices import PRICE_TYPE, parse_price


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def json_type(value: Column) -> Column:
    return F.schema_of_variant(value)


def string_at(value: Column, path: str) -> Column:
    """The value at ``path`` when it is a JSON string, else null."""
    return let(
        at(value, path),
        lambda found: F.when(json_type(found) == "STRING", F.try_variant_get(found, "$", "string")),
    )


def list_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def is_truthy(value: Column) -> Column:
    """False for a missing, null, zero, false or empty value."""


    def judge(found: Column) -> Column:
        kind, text = json_type(found), F.try_variant_get(found, "$", "string")
        number = F.try_variant_get(found, "$", "double")
        verdict = (
            F.when(kind == "STRING", text != "")
            .when(kind == "BOOLEAN", text == "true")
            .when(kind.rlike("^(ARRAY|OBJECT)"), ~text.isin("[]", "{}"))
            .otherwise(number != 0)
        )
        return F.coalesce(verdict, F.lit(False))

    return F.coalesce(let(value, judge), F.lit(False))


def number_or_text_price(value: Column) -> Column:
    """A JSON number as it is, the first number in a JSON string, else null."""
    return let(value, _price_of)


def _price_of(value: Column) -> Column:
    kind = json_type(value)
    number = F.try_variant_get(value, "$", PRICE_TYPE)
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number).when(
        kind == "STRING", parse_price(F.try_variant_get(value, "$", "string"))
    )


def cents_or_text_price(value: Column) -> Column:
    """An integer counts cents; anything else is read as a price."""

    def read(found: Column) -> Column:
        cents = F.try_variant_get(found, "$", "decimal(18,0)")
        return F.when(json_type(found) == "BIGINT", (cents / 100).cast(PRICE_TYPE)).otherwise(
            _price_of(found)
        )

    return let(value, read)


def script_blocks(tree: Column, kind: str) -> Column:
    """Script elements of a type that have content."""
    return F.filter(
        tree["nodes"],
        lambda n: (n["tag"] == "script") & (n["attrs"]["type"] == kind) & n["raw"].isNotNull(),
    )


def jsonld_blocks(tree: Column) -> Column:
    """Parsed JSON-LD blocks in document order; malformed ones are left out."""
    raw = script_blocks(tree, "application/ld+json")
    parsed = F.transform(raw, lambda n: F.try_parse_json(n["raw"]))
    return F.filter(parsed, lambda v: v.isNotNull())


def _wrapped(value: Column) -> Column:
    """Members of a list or of a list-valued @graph; null for anything else."""
    return F.coalesce(list_at(value, "$"), list_at(value, '$["@graph"]'))


def flatten_nodes(blocks: Column) -> Column:
    """Objects of all blocks with lists and @graph wrappers opened, in order.

    An object with a list-valued @graph is replaced by its members; an
    object-valued @graph is left alone. Each step opens one level; once nothing
    is left to open, the remaining steps only pass the array on. There are as
    many steps as the blocks have opening brackets, so no nesting is too deep.
    """

    def opened(nodes: Column) -> Column:
        return F.flatten(F.transform(nodes, lambda v: F.coalesce(_wrapped(v), F.array(v))))

    def with_flag(nodes: Column) -> Column:
        more = F.exists(nodes, lambda v: _wrapped(v).isNotNull())
        return F.struct(nodes.alias("nodes"), F.coalesce(more, F.lit(False)).alias("more"))

    def step(acc: Column, _: Column) -> Column:
        return F.when(acc["more"], let(opened(acc["nodes"]), with_flag)).otherwise(acc)

    def brackets(block: Column) -> Column:
        text = F.try_variant_get(block, "$", "string")
        return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("["))), F.lit(0))

    deepest = F.coalesce(F.array_max(F.transform(blocks, brackets)), F.lit(0))
    steps = F.sequence(F.lit(1), deepest + 1)
    flat = F.aggregate(steps, let(blocks, with_flag), step)
    return F.filter(flat["nodes"], is_object)


def node_types(node: Column) -> Column:
    """@type as an array of strings."""
    several = F.filter(list_at(node, '$["@type"]'), lambda t: json_type(t) == "STRING")
    return F.coalesce(
        F.transform(several, lambda t: F.try_variant_get(t, "$", "string")),
        F.array_compact(F.array(string_at(node, '$["@type"]'))),
    )

"""Assistant traces: tools in first-use order, required steps, message text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K


def tools_used(messages: DataFrame) -> DataFrame:
    """Distinct tools of every conversation, in order of first completed call.

    ``messages``: conv_id, turn, kind, name. Only kind 'tool' counts: a call
    that was merely asked for leaves no such message. Repeats are aggregated
    away first, so the array holds each tool name once.
    """
    first = (
        messages.where((F.col("kind") == "tool") & (F.col("name") != ""))
        .groupBy("conv_id", "name")
        .agg(F.min("turn").alias("turn"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("turn", "name")))
    return first.groupBy("conv_id").agg(
        F.transform(ordered, lambda m: m["name"]).alias("tools")
    )


def required_step(traces: DataFrame) -> DataFrame:
    """``save_verified``: was the route's required tool used (null when it has none).

    ``traces``: conv_id, route, tools.
    """
    needed = F.create_map(*[F.lit(x) for x in chain(*K.REQUIRED_STEP_BY_ROUTE.items())])
    tool = needed[F.col("route")]
    used = F.coalesce(F.exists("tools", lambda t: t == tool), F.lit(False))
    return traces.withColumn("save_verified", F.when(tool.isNotNull(), used))


def message_text(content: Column) -> Column:
    """Text of a message given as JSON: a string, or the 'text' blocks of a list."""
    parsed = F.try_parse_json(content)
    blocks = F.filter(
        F.try_variant_get(parsed, "$", "array<variant>"),
        lambda b: F.try_variant_get(b, "$.type", "string") == "text",
    )
    texts = F.transform(
        blocks, lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))
    )
    return F.coalesce(F.array_join(texts, ""), F.try_variant_get(parsed, "$", "string"))

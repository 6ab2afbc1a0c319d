"""Unique ids for new rows of a dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise


def assign_ids(fresh: DataFrame, existing: DataFrame, id_column: str, key: list[str]) -> DataFrame:
    """``fresh`` with ids above the highest existing one, fixed by writing them once.

    Ids count up inside range partitions sorted by ``key``, so no single task
    numbers everything. The result is written to the shared folder before use:
    recomputing a lost partition can never change an id in use.
    """
    highest = existing.agg(F.coalesce(F.max(id_column), F.lit(-1)).cast("bigint")).first()[0]
    numbered = (
        fresh.repartitionByRange(*key)
        .sortWithinPartitions(*key)
        .withColumn(id_column, F.lit(highest + 1) + F.monotonically_increasing_id())
    )
    return materialise(numbered, f"new-{id_column}")

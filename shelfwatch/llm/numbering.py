"""Gapless numbers within groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SPREAD = 256


def number_within(rows: DataFrame, group: list[str], order: list[str], name: str, spread: int = SPREAD) -> DataFrame:
    """``rows`` with 0, 1, 2, ... in ``name`` for each value of ``group``.

    Each group is cut in ``spread`` parts by a hash of ``order``. A part is
    numbered by itself and shifted by the sizes of the parts before it, of which
    there are at most ``spread`` a group. ``rows`` is read twice and must give the
    same rows both times, and ``order`` must identify a row.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int")
    dealt = rows.withColumn("part_no", part)
    sizes = dealt.groupBy(*group, "part_no").agg(F.count(F.lit(1)).alias("part_size"))
    before = F.sum("part_size").over(
        Window.partitionBy(*group).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = sizes.select(*group, "part_no", F.coalesce(before, F.lit(0)).alias("part_shift"))
    own: Column = F.row_number().over(Window.partitionBy(*group, "part_no").orderBy(*order))
    return (
        dealt.withColumn(name, own - 1)
        .join(F.broadcast(shifts), [*group, "part_no"])
        .withColumn(name, (F.col(name) + F.col("part_shift")).cast("bigint"))
        .drop("part_no", "part_shift", "part_size")
    )

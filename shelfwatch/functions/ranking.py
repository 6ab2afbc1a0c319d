"""Top-n rows and row numbers per group without sending a whole hot group to one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise, shuffled_in, sorted_parts

# Spark prunes each map task to n rows per group for limits up to this size
# (spark.sql.optimizer.windowGroupLimitThreshold); beyond it a salted first
# pass does the pruning.
GROUP_LIMIT_THRESHOLD = 1000
SALT_BUCKETS = 64


def top_n(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str = "rank_no",
    salt_on: Sequence[str] = (),
) -> DataFrame:
    """Keep the first ``n`` rows of every ``by`` group and number them from 1.

    ``order`` must be total. For large ``n`` the rows are first limited inside
    hash slices of ``salt_on`` columns, so that a hot group is cut down in
    parallel before it meets in one task.
    """
    if n > GROUP_LIMIT_THRESHOLD and salt_on:
        slice_no = F.pmod(F.xxhash64(*salt_on), F.lit(SALT_BUCKETS))
        first = Window.partitionBy(*by, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", slice_no)
            .withColumn("_slice_rank", F.row_number().over(first))
            .where(F.col("_slice_rank") <= n)
            .drop("_slice", "_slice_rank")
        )
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    name: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    compare: tuple[str, str, Callable[[Column, Column], Column]] | None = None,
) -> DataFrame:
    """All rows, numbered from 1 in every ``by`` group. ``order`` must be total.

    Rows are dealt in ranges of (group, order) and written once, so a hot group
    is many tasks: each range is numbered by itself and shifted by the sizes of
    the group's earlier ranges. There are more ranges the larger the input is, and a task numbers
    about one, so it holds no more rows of a larger table. ``prepare`` adds or drops costly columns once the
    rows are dealt: before that Spark reads them twice, as it samples for the ranges.

    ``compare`` (column, result, function) puts function(previous, current) of the
    column's values in a row and the row before it in place of the column.
    """
    many = sorted_parts(df)
    dealt = () if many is None else (many,)
    ranged = df.repartitionByRange(*dealt, *[F.col(c) for c in by], *order).withColumn(
        "_range", F.spark_partition_id()
    )
    with shuffled_in(df.sparkSession, many):
        ranged = materialise(ranged if prepare is None else prepare(ranged), "ranges")
    for c in by:
        ranged = ranged.where(F.col(c).isNotNull())
    split = ranged
    if by:
        # Ranges are contiguous, so two of them share one group at most: there are fewer split groups than ranges.
        span = ranged.groupBy(*by).agg(F.min("_range").alias("_from"), F.max("_range").alias("_to"))
        split = ranged.join(F.broadcast(span.where("_from < _to").select(*by)), [*by], "left_semi")
    ends = [F.count(F.lit(1)).alias("_size")]
    if compare is not None:
        value, result, function = compare
        ends += [f(value, F.struct(*order)).alias(n) for f, n in ((F.min_by, "_first"), (F.max_by, "_last"))]
    parts = split.groupBy(*by, "_range").agg(*ends)
    group = Window.partitionBy(*by).orderBy("_range")
    shift = F.sum("_size").over(group.rowsBetween(Window.unboundedPreceding, -1)).alias("_shift")
    met = [function(F.lag("_last").over(group), F.col("_first")).alias("_met")] if compare else []
    shifts = parts.select(*by, "_range", shift, *met).where("_shift IS NOT NULL")
    own = Window.partitionBy(*by, "_range").orderBy(*order)
    rows = ranged if many is None else ranged.repartitionByRange(many, *by, "_range")
    numbered = rows.withColumn(name, F.row_number().over(own))
    if compare is not None:
        numbered = numbered.withColumn("_previous", F.lag(value).over(own))
    numbered = numbered.join(F.broadcast(shifts), [*by, "_range"], "left")
    if compare is not None:
        met = F.when((F.col(name) == 1) & F.col("_shift").isNotNull(), F.col("_met"))
        met = met.otherwise(function(F.col("_previous"), F.col(value)))
        numbered = numbered.withColumn(result, met).drop(value, "_previous", "_met")
    return numbered.withColumn(name, F.col(name) + F.coalesce("_shift", F.lit(0))).drop("_range", "_shift")

"""Append targets. Everything is parquet in directories; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as K

OBSERVATION_KEY = ["product_id", "observed_at", "source"]


def append_observations(observations: DataFrame, path: str) -> None:
    """Append price observations, partitioned so that feed dedup reads feed rows only."""
    observations.write.mode("append").partitionBy("source").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """Append campaigns, news, analyses or crawl runs."""
    rows.write.mode("append").parquet(path)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def new_observations(incoming: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Incoming rows minus feed readings already stored.

    (product, observed_at, source) is unique among feed rows only: there the
    first row per key is kept and stored keys are skipped. Crawled rows always
    append.
    """
    is_feed = F.col("source") == K.FEED_SOURCE
    feed, crawled = incoming.where(is_feed), incoming.where(~is_feed)
    # The source is the same in all these rows: without it the join finds the groups where they are.
    key = [c for c in OBSERVATION_KEY if c != "source"]
    stored = existing.where(is_feed).select(*key)
    columns = [c for c in incoming.columns if c not in OBSERVATION_KEY]
    rest = [c for c in columns if c not in order]
    # The order, a file's name in a feed, travels once: as what is least, not inside the row as well.
    first = feed.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("first"), F.min(F.struct(*order)).alias("at")
    )
    fresh = first.join(stored, key, "left_anti").select(
        *key, F.lit(K.FEED_SOURCE).alias("source"), *[f"at.{c}" if c in order else f"first.{c}" for c in columns]
    )
    return fresh.unionByName(crawled)


def replace_table(rows: DataFrame, path: str) -> None:
    """Write a rewritten table as a new version directory; readers switch by path."""
    rows.write.mode("errorifexists").parquet(path)

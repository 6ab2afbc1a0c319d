"""Registered streams: the given line items arrive as an observation stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import observations as O
from .price_queries import ORACLES as PRICE_ORACLES
from .tables import OBSERVATION_ORDER, oracle, portable, table


def _stream(spark, sf_dir):
    """Line items as they would be read from a landing folder, one file set per trigger."""
    schema = table(spark, sf_dir, "lineitem").schema
    lines = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "lineitem.parquet")
        .parquet(sf_dir)
    )
    return lines.select(
        F.col("l_partkey").alias("product_id"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice").cast("decimal(12,2)")).alias("price"),
        F.lit("USD").alias("currency"),
        (F.col("l_returnflag") != "R").alias("in_stock"),
        F.col("l_shipdate").alias("observed_at"),
        F.when(F.col("l_linestatus") == "F", "internal_feed").otherwise("scheduled_crawl").alias("source"),
        "l_orderkey", "l_linenumber", "l_suppkey",
    )


def stream_dedup(spark, sf_dir):
    """Stored observations of both sources, all columns."""
    return portable(O.store_without_duplicates(_stream(spark, sf_dir), OBSERVATION_ORDER))


def stream_latest_price(spark, sf_dir):
    return portable(O.maintain_latest(_stream(spark, sf_dir), OBSERVATION_ORDER))


def stream_price_change(spark, sf_dir):
    return portable(O.maintain_changes(_stream(spark, sf_dir), OBSERVATION_ORDER))


QUERIES = {f.__name__: f for f in (stream_dedup, stream_latest_price, stream_price_change)}

_DESC = ", ".join(f"{c} DESC" for c in OBSERVATION_ORDER)

ORACLES = {
    "stream_dedup": oracle(
        ["observations"],
        f"""SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM observations
            QUALIFY source <> 'internal_feed' OR row_number() OVER (
                PARTITION BY product_id, observed_at, source ORDER BY {", ".join(OBSERVATION_ORDER)}) = 1""",
    ),
    "stream_latest_price": PRICE_ORACLES["latest_price"],
    "stream_price_change": oracle(
        ["observations"],
        f"""WITH last_two AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {_DESC}) AS rn
                              FROM observations),
            change AS (SELECT product_id, max(price) FILTER (rn = 1) AS latest_price,
                              max(price) FILTER (rn = 2) AS previous_price,
                              max(observed_at) FILTER (rn = 1) AS latest_at
                       FROM last_two WHERE rn <= 2 GROUP BY product_id)
            SELECT product_id, CAST(latest_price AS DOUBLE) AS latest_price,
                   CAST(previous_price AS DOUBLE) AS previous_price, latest_at,
                   CAST(latest_price - previous_price AS DOUBLE) AS price_change,
                   CASE WHEN previous_price <> 0 THEN round(CAST(latest_price - previous_price AS DOUBLE)
                       / CAST(previous_price AS DOUBLE) * 100, 6) END AS price_change_pct FROM change""",
    ),
}

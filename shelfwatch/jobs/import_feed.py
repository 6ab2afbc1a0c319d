"""Import the positional CSV price feed.

spark-submit -m shelfwatch.jobs.import_feed FEED_CSV SELLERS PRODUCTS OBSERVATIONS OWN_BRANDS_JSON

SELLERS, PRODUCTS and OBSERVATIONS are parquet folders. Sellers get the own
brands first; changed tables are written to new version folders, new
observations are appended, so the job can be run again.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession, functions as F

from .. import schemas
from ..operators.feed_import import import_feed
from ..operators.sellers import upsert_own_brands
from ..session import cleared_scratch
from ..sources import feed, registry, sinks


def run(
    spark: SparkSession, feed_path: str, sellers: str, products: str, observations: str, brands: str
) -> dict[str, str]:
    """Paths of the new seller and product versions."""
    with cleared_scratch(spark):
        return _import(spark, feed_path, sellers, products, observations, brands)


def _import(spark, feed_path, sellers, products, observations, brands) -> dict[str, str]:
    version = f"v{int(time.time() * 1000)}"
    now = F.current_timestamp().cast("timestamp_ntz")
    known_sellers = spark.read.schema(schemas.SELLERS).parquet(sellers)
    updated = upsert_own_brands(known_sellers, registry.read_own_brands(spark, brands))
    sellers_path = f"{sellers.rstrip('/')}-{version}"
    sinks.replace_table(updated.withColumn("created_at", F.coalesce("created_at", now)), sellers_path)

    known = spark.read.schema(schemas.PRODUCTS).parquet(products)
    stored = spark.read.schema(schemas.OBSERVATIONS).parquet(observations)
    parsed = feed.parse_feed(feed.read_feed(spark, feed_path))
    added, readings = import_feed(parsed, spark.read.parquet(sellers_path), known, stored)
    products_path = f"{products.rstrip('/')}-{version}"
    stamped = added.withColumn("first_seen_at", now).withColumn("last_seen_at", now)
    sinks.replace_table(known.unionByName(stamped, allowMissingColumns=True), products_path)
    sinks.append_observations(readings, observations)
    return {"sellers": sellers_path, "products": products_path}


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("feed_path", "sellers", "products", "observations", "brands"):
        parser.add_argument(name)
    spark = SparkSession.builder.appName("import-feed").getOrCreate()
    print(run(spark, **vars(parser.parse_args())))


if __name__ == "__main__":
    main()

"""Seller and own-brand registries: small JSON files kept by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SELLER_REGISTRY = (
    "slug STRING, name STRING, website_url STRING, active BOOLEAN, notes STRING, "
    "rate_limit_seconds DOUBLE, catalog_urls ARRAY<STRING>"
)
OWN_BRAND_REGISTRY = "brand_num INT, slug STRING, name STRING, website_url STRING, notes STRING"


def read_sellers(spark: SparkSession, path: str) -> DataFrame:
    """Active tracked sellers; a missing ``active`` flag counts as active."""
    registry = spark.read.schema(SELLER_REGISTRY).option("multiLine", True).json(path)
    return registry.fillna({"active": True}).where("active")


def read_own_brands(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OWN_BRAND_REGISTRY).option("multiLine", True).json(path)

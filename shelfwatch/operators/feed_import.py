"""First-party feed import: brand lookup, new products, observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..session import discard, fits_broadcast, lean_scratch, materialise, materialise_parts, part, parts_of
from ..sources.sinks import OBSERVATION_KEY, new_observations
from .ids import assign_ids

PRODUCT_KEY = ["seller_id", "sku", "name"]


def _own_brands(sellers: DataFrame) -> DataFrame:
    return sellers.where(F.col("brand_num").isNotNull()).select("brand_num", "seller_id")


def unknown_brands(feed: DataFrame, sellers: DataFrame) -> DataFrame:
    """Feed rows whose brand number has no seller."""
    brands = _own_brands(sellers)
    return feed.join(_small(brands), "brand_num", "left_anti")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if fits_broadcast(table) else table


def with_seller(feed: DataFrame, sellers: DataFrame, strict: bool = True) -> DataFrame:
    """Feed rows with ``seller_id``; an unknown brand fails the job unless lenient."""
    joined = feed.join(_small(_own_brands(sellers)), "brand_num", "left")
    missing = F.col("seller_id").isNull()
    if strict:
        message = F.concat(F.lit("no seller for brand number "), F.col("brand_num").cast("string"))
        return joined.where(F.when(missing, F.raise_error(message)).otherwise(True))
    return joined.where(~missing)


def new_products(feed: DataFrame, products: DataFrame, order: list[str]) -> DataFrame:
    """Products to add: the first feed row of every (seller, sku) not known yet.

    Later rows never change name, grade or category.
    """
    key = ["seller_id", "sku"]
    known = products.where(F.col("sku").isNotNull()).select(*key)
    first = F.min_by(F.struct("name", "grade", "category"), F.struct(*order)).alias("first")
    return (
        feed.groupBy(*key)
        .agg(first)
        .join(known, key, "left_anti")
        .select(*key, "first.*", F.lit("").alias("url"))
    )


def product_ids(products: DataFrame) -> DataFrame:
    """(seller, sku) -> product id; duplicate keys resolve to the lowest id."""
    return (
        products.where(F.col("sku").isNotNull())
        .groupBy("seller_id", "sku")
        .agg(F.min("product_id").alias("product_id"))
    )


def _part_key() -> list[Column]:
    return [F.col("seller_id").cast("bigint"), F.col("sku")]


def _with_product(feed: DataFrame, products: DataFrame, order: Sequence[str]) -> DataFrame:
    ids = product_ids(products)
    return feed.join(ids, ["seller_id", "sku"]).select("product_id", "price", "observed_at", *order)


def _as_observations(rows: DataFrame) -> DataFrame:
    kept = [c for c in rows.columns if c not in ("product_id", "price", "observed_at", "source")]
    return rows.select(
        "product_id",
        "price",
        F.lit(K.DEFAULT_CURRENCY).alias("currency"),
        F.col("price").isNotNull().alias("in_stock"),
        F.lit("").alias("promo_text"),
        "observed_at",
        F.lit(K.FEED_SOURCE).alias("source"),
        *kept,
    )


def observations(
    feed: DataFrame, products: DataFrame, order: tuple[str, ...] = ("row_order",)
) -> DataFrame:
    """Price observations of feed rows, with the ``order`` columns kept for first-row rules.

    ``products`` includes the newly added ones.
    """
    return _as_observations(_with_product(feed, products, order))


def _added(placed: DataFrame, products: DataFrame, order: list[str]) -> DataFrame:
    """The new products of ``placed`` with their ids, written; part by part like ``_new_readings``."""
    parts, key = parts_of(placed), _part_key()
    first = [new_products(part(placed, key, n, parts), part(products, key, n, parts), order) for n in range(parts)]
    fresh = materialise_parts(first, "new-products")
    added = assign_ids(fresh, products, "product_id", PRODUCT_KEY)
    discard(fresh)
    return added


def _new_readings(placed: DataFrame, products: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """The observations of ``placed`` that are new, written.

    Rows meet their products in parts of (seller, sku), and the stored readings in parts of the
    product, so that a part's shuffle files are gone before the next part's come.
    """
    parts, key = parts_of(placed), _part_key()
    met = [_with_product(part(placed, key, n, parts), part(products, key, n, parts), order) for n in range(parts)]
    known = materialise_parts(met, "known-products")
    parts, key = parts_of(known, existing), [F.col("product_id").cast("bigint")]
    fed = known.withColumn("source", F.lit(K.FEED_SOURCE))  # what follows from the price comes after the shuffle
    fresh = [
        new_observations(part(fed, key, n, parts), part(existing, key, n, parts), order).drop(*order)
        for n in range(parts)
    ]
    columns = [*OBSERVATION_KEY, "price", "currency", "in_stock", "promo_text"]
    readings = materialise_parts([_as_observations(f).select(*columns) for f in fresh], "readings")
    discard(known)
    return readings


def import_feed(
    feed: DataFrame,
    sellers: DataFrame,
    products: DataFrame,
    existing: DataFrame,
    order: tuple[str, ...] = ("row_order",),
    strict: bool = True,
    written: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(products to add, observations to append) for a parsed feed, both written; safe to re-run.

    The feed is parsed and given its sellers once, and written; both results read that. A feed that
    is ``written`` already is not written again.
    """
    placed = with_seller(feed, sellers, strict)
    with lean_scratch(feed.sparkSession):
        if not written:
            placed = materialise(placed, "placed-feed")
        added = _added(placed, products, list(order))
        every = products.select("product_id", "seller_id", "sku").unionByName(
            added.select("product_id", "seller_id", "sku")
        )
        readings = _new_readings(placed, every, existing, list(order))
        if not written:
            discard(placed)
    return added, readings

"""Price history: latest price, last change, trend, series and axis.

Observations carry ``product_id, price, currency, in_stock, observed_at, source``
plus whatever columns ``order`` names; ``order`` is a total order per product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.prices import nice_step
from ..functions.ranking import number_rows, top_n
from ..functions.text import contains_ignoring_case


def within_days(moment: str, as_of: str, days: int) -> Column:
    """``moment >= as_of - days`` on the bare column, so it is pushed to the scan."""
    since = F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{int(days)}' DAY")
    return F.col(moment) >= since


def latest_price(observations: DataFrame, order: Sequence[str]) -> DataFrame:
    """The newest observation of every product, even when its price is null."""
    kept = [c for c in ("price", "currency", "in_stock", "observed_at", "source")]
    newest = F.max_by(F.struct(*kept), F.struct(*order)).alias("newest")
    return observations.groupBy("product_id").agg(newest).select("product_id", "newest.*")


def price_change(
    observations: DataFrame, order: Sequence[str], as_of: str, days: int = K.DEFAULT_TREND_DAYS
) -> DataFrame:
    """Last against previous observation inside the look-back, for every product.

    Each map task keeps two rows per product before the shuffle, so a product
    with very many observations costs no more than any other.
    """
    recent = observations.where(within_days("observed_at", as_of, days)).select(
        "product_id", "price", *order
    )
    last_two = top_n(recent, ["product_id"], [F.col(c).desc() for c in order], 2)
    newest, previous = F.col("rank_no") == 1, F.col("rank_no") == 2
    change = F.col("latest_price") - F.col("previous_price")
    percent = F.when(
        F.col("previous_price") != 0,
        F.round(
            change.cast("double") / F.col("previous_price").cast("double") * 100, 6
        ),
    )
    return (
        last_two.groupBy("product_id")
        .agg(
            F.max(F.when(newest, F.col("price"))).alias("latest_price"),
            F.max(F.when(previous, F.col("price"))).alias("previous_price"),
            F.max(F.when(newest, F.col("observed_at"))).alias("latest_at"),
        )
        .withColumn("price_change", change)
        .withColumn("price_change_pct", percent)
    )


def price_trend(
    products: DataFrame,
    observations: DataFrame,
    order: Sequence[str],
    as_of: str,
    days: int = K.DEFAULT_TREND_DAYS,
) -> DataFrame:
    """Every product's observations in the look-back with its change columns.

    One row per observation rather than one array per product: a product's
    history has no size bound. Products without observations keep one row with
    a null ``observed_at``.
    """
    change = price_change(observations, order, as_of, days).drop("previous_price")
    heads = products.select(
        "product_id", F.col("name").alias("product_name"), F.col("url").alias("product_url")
    ).join(change, "product_id", "left")
    points = observations.where(within_days("observed_at", as_of, days)).select(
        "product_id", "price", "currency", "in_stock", "source", *order
    )
    with_points = heads.where(F.col("latest_at").isNotNull()).join(points, "product_id")
    without = heads.where(F.col("latest_at").isNull())
    return with_points.unionByName(without, allowMissingColumns=True).drop("latest_at")


def price_series(
    observations: DataFrame, order: Sequence[str], as_of: str, days: int
) -> DataFrame:
    """Priced points of products that have at least two of them."""
    priced = observations.where(
        within_days("observed_at", as_of, days) & F.col("price").isNotNull()
    ).select("product_id", "price", *order)
    enough = (
        priced.groupBy("product_id").agg(F.count("*").alias("points")).where("points >= 2")
    )
    return priced.join(enough, "product_id", "left_semi")


def price_axis(observations: DataFrame, as_of: str, days: int) -> DataFrame:
    """Date range and rounded price range of every chartable product."""
    priced = observations.where(
        within_days("observed_at", as_of, days) & F.col("price").isNotNull()
    )
    ranges = (
        priced.groupBy("product_id")
        .agg(
            F.count("*").alias("points"),
            F.min("observed_at").alias("min_date"),
            F.max("observed_at").alias("max_date"),
            F.min("price").cast("double").alias("min_price"),
            F.max("price").cast("double").alias("max_price"),
        )
        .where("points >= 2")
    )
    step = F.col("step")
    low = F.floor(F.col("min_price") / step) * step - step
    high = F.ceil(F.col("max_price") / step) * step + step
    return (
        ranges.withColumn("step", nice_step(F.col("max_price") - F.col("min_price")))
        .withColumn("y_min", F.greatest(F.lit(0.0), low))
        .withColumn("y_max", high)
    )


def price_history_search(
    products: DataFrame,
    observations: DataFrame,
    name_query: str,
    as_of: str,
    days: int,
    seller_id: int | None = None,
    order: Sequence[str] = ("observed_at",),
) -> DataFrame:
    """Observations of products whose name contains the query; ``position`` counts by name and time.

    ``order`` is the total order of one product's observations. Products that go
    with a ``guess`` (see ``sellers.rows_by_guess``) are numbered under each guess.
    """
    matching = products.where(contains_ignoring_case(F.col("name"), name_query))
    if seller_id is not None:
        matching = matching.where(F.col("seller_id") == seller_id)
    recent = observations.where(within_days("observed_at", as_of, days))
    kept = [c for c in ("guess", "product_id", "seller_id", "name") if c in matching.columns]
    found = matching.select(*kept).join(recent, "product_id")
    by = [c for c in ("guess",) if c in products.columns]
    return number_rows(found, by, [F.col(c) for c in ("name", *order, "product_id")], "position")


def price_history_lines(history: DataFrame) -> DataFrame:
    """One readable line per observation of ``price_history_search``."""
    moment = F.when(
        F.date_trunc("second", F.col("observed_at")) == F.col("observed_at"),
        F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss"),
    ).otherwise(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    shown = F.coalesce(
        F.concat(F.col("price").cast("string"), F.lit(" "), F.col("currency")),
        F.lit("no price shown"),
    )
    stock = F.when(F.col("in_stock"), F.lit("in stock")).otherwise(F.lit("out of stock"))
    line = F.concat(
        F.lit("[product_id="), F.col("product_id").cast("string"), F.lit("] "), F.col("name"),
        F.lit(": "), shown, F.lit(" ("), stock, F.lit(") at "), moment,
    )
    return history.select("product_id", line.alias("line"))

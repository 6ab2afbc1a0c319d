"""Price, stock and season parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K
from .text import blank_to_null, strip

PRICE_TYPE = "decimal(18,4)"


def parse_price(col: Column) -> Column:
    """First number in a string with thousands separators removed; null if none."""
    digits = F.regexp_extract(F.replace(col, F.lit(","), F.lit("")), K.PRICE_NUMBER, 0)
    return blank_to_null(digits).try_cast(PRICE_TYPE)


def parse_availability(col: Column) -> Column:
    """False only for a known out-of-stock token; a missing value means in stock."""
    token = F.lower(strip(F.substring_index(col, "/", -1)))
    return F.coalesce(~token.isin(K.OUT_OF_STOCK_TOKENS), F.lit(True))


def parse_season(col: Column) -> Column:
    """F25 -> 2025-09-01, S26 -> 2026-03-01; null when not a season code."""
    code = strip(col)
    year = F.lit(2000) + F.substring(code, 2, 2).try_cast("int")
    month = F.when(F.upper(F.left(code, F.lit(1))) == "S", 3).otherwise(9)
    first = F.lit(1)
    return F.when(
        code.rlike(K.SEASON_CODE),
        F.make_date(year, month, first).cast("timestamp_ntz"),
    )


def is_null_marker(col: Column) -> Column:
    return F.upper(strip(col)) == "NULL"


def parse_feed_price(col: Column) -> Column:
    """Feed price; the NULL marker and unreadable text both give null.

    Use ``feed_price_is_bad`` to tell the two apart.
    """
    return F.when(~is_null_marker(col), strip(col).try_cast("decimal(12,2)"))


def feed_price_is_bad(col: Column) -> Column:
    return ~is_null_marker(col) & strip(col).try_cast("decimal(12,2)").isNull()


def markdown_price(original: Column, price: Column) -> Column:
    """The original price, unless it is no higher than the price."""
    return F.when(price.isNull() | (original > price), original)


def promo_text(promo: Column, currency: Column, original: Column, price: Column) -> Column:
    """Promo text with 'Was CUR X' appended when the original price differs."""
    was = F.when(
        original.isNotNull() & ~original.eqNullSafe(price),
        F.concat(F.lit("Was "), currency, F.lit(" "), original.cast("string")),
    )
    return F.concat_ws("; ", blank_to_null(promo), was)


def nice_step(spread: Column) -> Column:
    """Gridline step: 1, 2, 2.5, 5 or 10 times a power of ten, from a quarter of the spread."""
    rough = F.when(spread == 0, F.lit(1.0)).otherwise(spread) / 4
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    share = rough / magnitude
    step = F.lit(10.0)
    for candidate in (5.0, 2.5, 2.0, 1.0):
        step = F.when(share <= candidate, F.lit(candidate)).otherwise(step)
    return step * magnitude

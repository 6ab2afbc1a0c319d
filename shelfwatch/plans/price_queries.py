"""Registered price queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prices
from .tables import AS_OF, OBSERVATION_ORDER, TREND_DAYS, oracle, portable, view

_SINCE = f"TIMESTAMP '{AS_OF}' - INTERVAL {TREND_DAYS} DAY"
_DESC = ", ".join(f"{c} DESC" for c in OBSERVATION_ORDER)


def latest_price(spark, sf_dir):
    return portable(prices.latest_price(view(spark, sf_dir, "observations"), OBSERVATION_ORDER))


def price_change(spark, sf_dir):
    obs = view(spark, sf_dir, "observations")
    return portable(prices.price_change(obs, OBSERVATION_ORDER, AS_OF, TREND_DAYS))


def price_trend(spark, sf_dir):
    trend = prices.price_trend(
        view(spark, sf_dir, "products"),
        view(spark, sf_dir, "observations"),
        OBSERVATION_ORDER,
        AS_OF,
        TREND_DAYS,
    )
    return portable(trend)


def price_series(spark, sf_dir):
    obs = view(spark, sf_dir, "observations")
    return portable(prices.price_series(obs, OBSERVATION_ORDER, AS_OF, 3650))


def price_axis(spark, sf_dir):
    axis = prices.price_axis(view(spark, sf_dir, "observations"), AS_OF, 3650)
    rounded = [F.round(c, 6).alias(c) for c in ("step", "y_min", "y_max")]
    return axis.select("product_id", "points", "min_date", "max_date", "min_price", "max_price", *rounded)


def _history(spark, sf_dir):
    return prices.price_history_search(
        view(spark, sf_dir, "products"), view(spark, sf_dir, "observations"), "ReD", AS_OF, 3650,
        order=OBSERVATION_ORDER,
    )


def price_history_search(spark, sf_dir):
    return portable(_history(spark, sf_dir).drop("l_orderkey", "l_linenumber", "l_suppkey"))


def price_history_lines(spark, sf_dir):
    return prices.price_history_lines(_history(spark, sf_dir))


QUERIES = {
    "latest_price": latest_price,
    "price_change": price_change,
    "price_trend": price_trend,
    "price_series": price_series,
    "price_axis": price_axis,
    "price_history_search": price_history_search,
    "price_history_lines": price_history_lines,
}

_CHANGE = f"""
    last_two AS (
        SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {_DESC}) AS rn
        FROM observations WHERE observed_at >= {_SINCE}),
    change AS (
        SELECT product_id, max(price) FILTER (rn = 1) AS latest_price,
               max(price) FILTER (rn = 2) AS previous_price,
               max(observed_at) FILTER (rn = 1) AS latest_at
        FROM last_two WHERE rn <= 2 GROUP BY product_id)"""
_PCT = """CASE WHEN previous_price <> 0 THEN
    round(CAST(latest_price - previous_price AS DOUBLE) / CAST(previous_price AS DOUBLE) * 100, 6)
    END"""
_STEP = """
    CASE WHEN share <= 1 THEN 1.0 WHEN share <= 2 THEN 2.0 WHEN share <= 2.5 THEN 2.5
         WHEN share <= 5 THEN 5.0 ELSE 10.0 END * magnitude"""

ORACLES = {
    "latest_price": oracle(
        ["observations"],
        f"""SELECT product_id, CAST(price AS DOUBLE) AS price, currency, in_stock, observed_at, source
            FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {_DESC}) AS rn
                  FROM observations) WHERE rn = 1""",
    ),
    "price_change": oracle(
        ["observations"],
        f"""WITH {_CHANGE}
            SELECT product_id, CAST(latest_price AS DOUBLE) AS latest_price,
                   CAST(previous_price AS DOUBLE) AS previous_price, latest_at,
                   CAST(latest_price - previous_price AS DOUBLE) AS price_change,
                   {_PCT} AS price_change_pct FROM change""",
    ),
    "price_trend": oracle(
        ["products", "observations"],
        f"""WITH {_CHANGE}
            SELECT p.product_id, p.name AS product_name, p.url AS product_url,
                   CAST(latest_price AS DOUBLE) AS latest_price,
                   CAST(latest_price - previous_price AS DOUBLE) AS price_change,
                   {_PCT} AS price_change_pct, CAST(o.price AS DOUBLE) AS price, o.currency,
                   o.in_stock, o.source, o.observed_at, o.l_orderkey, o.l_linenumber, o.l_suppkey
            FROM products p LEFT JOIN change USING (product_id)
            LEFT JOIN (SELECT * FROM observations WHERE observed_at >= {_SINCE}) o
              ON o.product_id = p.product_id""",
    ),
    "price_series": oracle(
        ["observations"],
        f"""SELECT product_id, CAST(price AS DOUBLE) AS price, {", ".join(OBSERVATION_ORDER)}
            FROM (SELECT *, count(*) OVER (PARTITION BY product_id) AS points FROM observations
                  WHERE price IS NOT NULL
                    AND observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3650 DAY)
            WHERE points >= 2""",
    ),
    "price_axis": oracle(
        ["observations"],
        f"""WITH ranges AS (
                SELECT product_id, count(*) AS points, min(observed_at) AS min_date,
                       max(observed_at) AS max_date, CAST(min(price) AS DOUBLE) AS min_price,
                       CAST(max(price) AS DOUBLE) AS max_price
                FROM observations WHERE price IS NOT NULL
                  AND observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3650 DAY
                GROUP BY product_id HAVING count(*) >= 2),
            rough AS (SELECT *, (CASE WHEN max_price = min_price THEN 1 ELSE max_price - min_price END)
                             / 4 AS rough FROM ranges),
            scaled AS (SELECT *, pow(10, floor(log10(rough))) AS magnitude,
                              rough / pow(10, floor(log10(rough))) AS share FROM rough),
            stepped AS (SELECT *, {_STEP} AS step FROM scaled)
            SELECT product_id, points, min_date, max_date, min_price, max_price,
                   round(step, 6) AS step,
                   round(greatest(0, floor(min_price / step) * step - step), 6) AS y_min,
                   round(ceil(max_price / step) * step + step, 6) AS y_max FROM stepped""",
    ),
    "price_history_search": oracle(
        ["products", "observations"],
        f"""SELECT product_id, seller_id, name, CAST(price AS DOUBLE) AS price, currency, in_stock,
                   observed_at, source, row_number() OVER (ORDER BY name, {", ".join(OBSERVATION_ORDER)}, product_id) AS position
            FROM products JOIN observations USING (product_id)
            WHERE name ILIKE '%ReD%' AND observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3650 DAY""",
    ),
    "price_history_lines": oracle(
        ["products", "observations"],
        f"""SELECT product_id, '[product_id=' || product_id || '] ' || name || ': '
                   || coalesce(CAST(price AS VARCHAR) || ' ' || currency, 'no price shown') || ' ('
                   || CASE WHEN in_stock THEN 'in stock' ELSE 'out of stock' END || ') at '
                   || strftime(observed_at, '%Y-%m-%dT%H:%M:%S') AS line
            FROM products JOIN observations USING (product_id)
            WHERE name ILIKE '%ReD%' AND observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3650 DAY""",
    ),
}

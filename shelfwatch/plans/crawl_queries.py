"""Registered queries of whole crawl runs.

Every row of ``part`` is one stored page with one product card and one banner:
two listings, product, promotion and home pages for each seller. Some pages do
not parse and some listings end early.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl as O
from .load_queries import _runs, _scored
from .tables import oracle, portable, view

_TEXT = "banner || ' ' || name || ' $' || price || ' see ' || CAST(id AS STRING)"
VIEW = """
    SELECT seller AS run_id, seller AS seller_id, kind, id, id AS page_idx, name, price, banner, discount, broken, last_page,
           CASE WHEN kind = 'category' THEN seller * 10 + size % 4 END AS crawl,
           'https://www.shop' || CAST(seller AS STRING) || '.example' AS base_url,
           'https://www.shop' || CAST(seller AS STRING) || '.example/' || kind || '/' || CAST(id AS STRING) AS url,
           shipped AS fetched_at
    FROM (
        SELECT p_partkey AS id, CAST(substr(p_brand, 7) AS BIGINT) AS seller, p_size AS size, p_name AS name,
               CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING) AS price,
               CASE WHEN p_size % 4 < 2 THEN 'category' WHEN p_size % 4 = 2 THEN 'product'
                    WHEN p_partkey % 2 = 0 THEN 'promo' ELSE 'homepage' END AS kind,
               CASE WHEN p_size % 3 = 1 THEN 'clearance corner ' || CAST(p_partkey AS STRING)
                    ELSE 'aisle ' || CAST(p_partkey AS STRING) || ': ' || CAST(p_partkey % 6 * 5 + 5 AS STRING) || '% off' END AS banner,
               CASE WHEN p_size % 3 <> 1 THEN CAST(p_partkey % 6 * 5 + 5 AS STRING) || '% off' END AS discount,
               p_partkey % 29 = 0 AS broken, p_partkey % 17 = 0 AS last_page,
               TIMESTAMP '2026-01-01 00:00:00' + (p_partkey % 1000) * INTERVAL '1' HOUR AS shipped
        FROM {part})"""
_HTML = """
    '<html><head>' || CASE WHEN last_page THEN '' ELSE '<link rel="next" href="?more">' END || '</head><body><aside class="promo">'
    || banner || '</aside><article class="product"><h4>' || name || '</h4><p class="price">$' || price
    || '</p><a href="/products/' || CAST(id AS STRING) || '">see ' || CAST(id AS STRING) || '</a></article>'
    || CASE WHEN broken THEN '<![x[y]]>' ELSE '' END || '</body></html>'"""


def _pages(spark, sf_dir):
    rows = spark.sql(VIEW, part=view(spark, sf_dir, "part"))
    return rows.select(
        "run_id", "kind", "crawl", "page_idx", "seller_id", "base_url", "url",
        F.concat(F.lit("brand-"), F.col("seller_id").cast("string")).alias("slug"),
        F.expr(_HTML).alias("html"), F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"),
    )


def _result(spark, sf_dir):
    campaigns = spark.createDataFrame([], "seller_id BIGINT, product_id BIGINT, discount_text STRING")
    never = F.lit(None).cast("timestamp_ntz")
    known = view(spark, sf_dir, "known_products").withColumn("first_seen_at", never).withColumn("last_seen_at", never)
    return O.ingest_run(_pages(spark, sf_dir), known, campaigns)


def crawl_products(spark, sf_dir):
    """Products after the runs; new ids are arbitrary, so they are left out."""
    after = _result(spark, sf_dir).products
    return after.withColumn("product_id", F.when(~F.col("is_new"), F.col("product_id")))


def crawl_observations(spark, sf_dir):
    """Price readings of the runs, shown by seller and product name."""
    result = _result(spark, sf_dir)
    names = result.products.select("product_id", "seller_id", "name")
    return portable(result.observations.join(names, "product_id").drop("product_id"))


def crawl_campaigns(spark, sf_dir):
    return _result(spark, sf_dir).campaigns.drop("product_id")


def crawl_product_links(spark, sf_dir):
    return _result(spark, sf_dir).product_links


def crawl_page_errors(spark, sf_dir):
    errors = _result(spark, sf_dir).page_errors
    return errors.select("run_id", "kind", "crawl", "page_idx", "url", (F.length("error") > 0).alias("has_message"))


def crawl_runs(spark, sf_dir):
    return _result(spark, sf_dir).runs


def crawl_run_errors(spark, sf_dir):
    return _result(spark, sf_dir).run_errors


QUERIES = {
    f.__name__: f
    for f in (
        crawl_products, crawl_observations, crawl_campaigns, crawl_product_links, crawl_page_errors,
        crawl_runs, crawl_run_errors,
    )
}

_STORED = f"""
    stored AS (SELECT *, {_TEXT} AS text FROM ({VIEW.format(part="part")})),
    listing AS (SELECT *, row_number() OVER (PARTITION BY crawl ORDER BY page_idx) AS page_no FROM stored WHERE kind = 'category'),
    whole AS (SELECT crawl, page_idx, page_no, CASE WHEN broken THEN '' ELSE text END AS shown FROM listing),
    runs AS ({_runs("whole", "shown", "crawl, page_idx, page_no")}),
    scored AS ({_scored("runs", "crawl", "page_no", "crawl, page_idx")}),
    flagged AS (SELECT l.*, CASE WHEN broken THEN 'failed' WHEN similarity > 0.5 THEN 'recycled'
                                 WHEN last_page THEN 'no_next_link' END AS reason
                FROM listing l LEFT JOIN scored USING (crawl, page_idx)),
    reached AS (SELECT * FROM flagged f WHERE NOT EXISTS (
                    SELECT 1 FROM flagged e WHERE e.crawl = f.crawl AND e.page_no < f.page_no AND e.reason IS NOT NULL)),
    used AS (SELECT * FROM reached WHERE coalesce(reason, '') NOT IN ('failed', 'recycled')),
    items AS (
        SELECT run_id, seller_id, 1 AS kind_no, crawl, page_idx, url, name, price, id, fetched_at FROM used
        QUALIFY row_number() OVER (PARTITION BY crawl, name ORDER BY page_idx) = 1
        UNION ALL SELECT run_id, seller_id, 2, NULL, page_idx, url, name, price, id, fetched_at FROM stored
        WHERE kind = 'product' AND NOT broken),
    name_ids AS (SELECT seller_id, name, min(product_id) AS id FROM known_products GROUP BY ALL),
    shown AS (SELECT i.*, n.id AS product_id FROM items i LEFT JOIN name_ids n ON n.seller_id = i.seller_id AND n.name = i.name),
    seen AS (SELECT seller_id, name, product_id, arg_max(id, (kind_no, coalesce(crawl, 0), page_idx)) AS last_id,
                    min(fetched_at) AS from_time, max(fetched_at) AS to_time FROM shown GROUP BY ALL),
    units AS (
        SELECT run_id, kind, url, broken AS failed, NOT broken AS counted FROM (
            SELECT run_id, kind, arg_min(url, page_idx) AS url, bool_or(broken) AS broken FROM reached GROUP BY run_id, kind, crawl)
        UNION ALL SELECT run_id, kind, url, broken, TRUE FROM stored WHERE kind <> 'category')"""


def _over(body):
    return oracle(["known_products"], f"WITH {_STORED} {body}")


_SITE = "'https://www.shop' || CAST(seller_id AS VARCHAR) || '.example'"
ORACLES = {
    "crawl_products": _over(f"""
        SELECT k.product_id, k.seller_id, k.sku, k.name, k.category,
               CASE WHEN s.name IS NULL THEN k.url
                    ELSE 'https://www.shop' || k.seller_id || '.example/products/' || s.last_id END AS url,
               s.from_time AS first_seen_at, s.to_time AS last_seen_at, FALSE AS is_new, s.name IS NOT NULL AS seen
        FROM known_products k LEFT JOIN seen s ON s.product_id = k.product_id
        UNION ALL SELECT NULL, seller_id, NULL, name, '', {_SITE} || '/products/' || last_id, from_time, to_time, TRUE, TRUE
        FROM seen WHERE product_id IS NULL"""),
    "crawl_observations": _over("""
        SELECT seller_id, name, CAST(price AS DOUBLE) AS price, 'USD' AS currency, TRUE AS in_stock, '' AS promo_text,
               fetched_at AS observed_at, 'scheduled_crawl' AS source FROM shown"""),
    "crawl_campaigns": _over("""
        SELECT seller_id, discount AS discount_text, run_id, banner AS title, banner AS description, url AS source_url FROM (
            SELECT *, 1 AS kind_no FROM (SELECT * EXCLUDE (text, page_no, reason) FROM used)
            UNION ALL SELECT * EXCLUDE (text), CASE kind WHEN 'promo' THEN 3 ELSE 4 END FROM stored
            WHERE kind IN ('promo', 'homepage') AND NOT broken)
        WHERE discount IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY seller_id, discount ORDER BY kind_no, coalesce(crawl, 0), page_idx) = 1"""),
    "crawl_product_links": _over(f"SELECT DISTINCT run_id, crawl, {_SITE} || '/products/' || id AS url FROM used"),
    "crawl_page_errors": _over(
        "SELECT run_id, kind, crawl, page_idx, url, TRUE AS has_message FROM stored WHERE broken"
    ),
    "crawl_runs": _over("""
        SELECT run_id, count(*) FILTER (counted) AS pages_fetched, count(*) FILTER (failed) AS errors,
               CASE WHEN count(*) FILTER (failed) = 0 THEN 'success'
                    WHEN count(*) FILTER (counted) = 0 THEN 'failed' ELSE 'partial_failure' END AS status,
               any_value(seller_id) AS seller_id, any_value(started_at) AS started_at, any_value(finished_at) AS finished_at
        FROM units JOIN (SELECT run_id, min(seller_id) AS seller_id, min(fetched_at) AS started_at,
                                max(fetched_at) AS finished_at FROM stored GROUP BY 1) USING (run_id) GROUP BY run_id"""),
    "crawl_run_errors": _over("""
        SELECT run_id, CASE kind WHEN 'homepage' THEN 'homepage ' || url || ': fetch failed'
                            ELSE kind || ' ' || url || ': fetch/extract failed' END AS line
        FROM units WHERE failed"""),
}

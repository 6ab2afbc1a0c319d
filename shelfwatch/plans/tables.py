"""The given parquet tables seen as price-intelligence tables.

Each view is one SQL text that runs unchanged in Spark and in DuckDB, so both
sides of the correctness check start from the same definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    "sellers": """
        SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS seller_id,
               lower(replace(p_brand, '#', '-')) AS slug, p_brand AS name,
               CAST(substr(p_brand, 7) AS INT) <= 7 AS is_own_brand
        FROM {part}""",
    "products": """
        SELECT p_partkey AS product_id, CAST(substr(p_brand, 7) AS INT) AS seller_id,
               CASE WHEN p_partkey % 3 = 0 THEN NULL
                    ELSE 'SKU' || CAST(p_partkey AS STRING) END AS sku,
               p_name AS name, p_type AS category, CAST(p_size AS STRING) AS grade,
               'https://www.shop' || substr(p_brand, 7) || '.example/products/'
                   || CAST(p_partkey AS STRING) AS url
        FROM {part}""",
    "observations": """
        SELECT l_partkey AS product_id,
               CASE WHEN l_returnflag = 'R' THEN NULL
                    ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS price,
               'USD' AS currency, l_returnflag <> 'R' AS in_stock, l_shipdate AS observed_at,
               CASE WHEN l_linestatus = 'F' THEN 'internal_feed'
                    ELSE 'scheduled_crawl' END AS source,
               l_orderkey, l_linenumber, l_suppkey
        FROM {lineitem}""",
    "crawl_runs": """
        SELECT o_orderkey AS run_id, CAST(o_custkey % 25 + 1 AS INT) AS seller_id,
               o_orderdate AS started_at,
               CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'partial_failure'
                    ELSE 'success' END AS status
        FROM {orders}""",
    "campaigns": """
        SELECT event_id AS campaign_id, CAST(user_id % 25 + 1 AS INT) AS seller_id,
               CASE WHEN event_type = 'signup' THEN NULL ELSE user_id % 200 END AS product_id,
               CAST(CAST(floor(value) AS BIGINT) % 7 * 5 + 5 AS STRING) || '% off' AS discount_text,
               event_type AS title, props AS description, ts AS discovered_at,
               CASE WHEN value < 20 THEN ts ELSE NULL END AS starts_at,
               CASE WHEN value > 5 THEN ts ELSE NULL END AS ends_at
        FROM {events} WHERE event_type IN ('purchase', 'signup')""",
    "developments": """
        SELECT e.vec_id AS development_id, e.label + 1 AS seller_id, v.event_type AS title,
               v.props AS summary, 'launch' AS category, v.ts AS event_date,
               v.ts AS discovered_at, e.embedding
        FROM {embeddings} e JOIN {events} v ON v.event_id = e.vec_id""",
    "swot_analyses": """
        SELECT event_id AS swot_id, CAST(user_id % 25 + 1 AS INT) AS seller_id,
               props AS source_summary, event_type AS model_used, ts AS generated_at
        FROM {events} WHERE event_type IN ('error', 'view')""",
    "feed_rows": """
        SELECT CAST(l_partkey AS STRING) AS sku, CAST(l_suppkey % 7 + 1 AS STRING) AS brand_num,
               p_type AS category, ' ' || p_name || ' ' AS name, CAST(p_size AS STRING) AS grade,
               CASE WHEN month(l_shipdate) BETWEEN 3 AND 8 THEN 'S' ELSE 'f' END
                   || substr(CAST(year(l_shipdate) AS STRING), 3, 2) AS season,
               CASE WHEN l_returnflag = 'R' THEN 'NULL'
                    ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) END AS price,
               l_orderkey, l_linenumber, l_suppkey, l_shipdate
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    # Products known before the feed arrives, with the feed's own sku spelling.
    "known_feed_products": """
        SELECT p_partkey AS product_id, CAST(p_partkey % 7 + 1 AS INT) AS seller_id,
               CAST(p_partkey AS STRING) AS sku
        FROM {part} WHERE p_type = 'ECONOMY'""",
    # Products known before a crawl.
    "known_products": """
        SELECT p_partkey AS product_id, CAST(substr(p_brand, 7) AS INT) AS seller_id,
               CASE WHEN p_size > 20 THEN 'SKU' || CAST(p_partkey AS STRING) END AS sku,
               p_name AS name, p_type AS category, '' AS url
        FROM {part} WHERE p_type <> 'SMALL'""",
    # Items found on pages: page = order, position = line and supplier.
    "page_items": """
        SELECT l_orderkey AS crawl, CAST(l_linenumber AS INT) AS page_idx,
               l_suppkey AS pos, l_partkey, l_shipdate, p_name AS name,
               CAST(substr(p_brand, 7) AS INT) AS seller_id,
               CASE WHEN p_partkey % 3 = 0 THEN NULL
                    ELSE 'SKU' || CAST(p_partkey AS STRING) END AS sku,
               CASE WHEN l_linestatus = 'F' THEN p_type ELSE '' END AS category,
               'https://shop.example/' || CAST(l_orderkey AS STRING) || '/'
                   || CAST(l_linenumber AS STRING) AS url,
               CASE WHEN l_returnflag = 'R' THEN NULL
                    ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS price
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
}

# Look-back queries take their "now" as a parameter.
AS_OF = "2001-12-01 00:00:00"
TREND_DAYS = 365

# Total order of one product's observations.
OBSERVATION_ORDER = ["observed_at", "l_orderkey", "l_linenumber", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or one of the views above."""
    if name in BASE_TABLES:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in BASE_TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def oracle(names: list[str], body: str) -> str:
    """``body`` over the named views, as one DuckDB statement."""
    plain = {t: t for t in BASE_TABLES}
    ctes = ", ".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in names)
    body = body.strip()
    if not names:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def portable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so both engines hand over the same value types."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if field.dataType.typeName() == "decimal":
            column = column.cast("double").alias(field.name)
        columns.append(column)
    return df.select(*columns)

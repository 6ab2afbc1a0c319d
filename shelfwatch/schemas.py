"""Table and record schemas. Timestamps are naive UTC (TIMESTAMP_NTZ)."""

SELLERS = (
    "seller_id BIGINT, slug STRING, name STRING, website_url STRING, notes STRING, "
    "created_at TIMESTAMP_NTZ, is_own_brand BOOLEAN, brand_num INT"
)
PRODUCTS = (
    "product_id BIGINT, seller_id BIGINT, sku STRING, name STRING, grade STRING, "
    "category STRING, url STRING, first_seen_at TIMESTAMP_NTZ, last_seen_at TIMESTAMP_NTZ"
)
OBSERVATIONS = (
    "product_id BIGINT, price DECIMAL(10,2), currency STRING, in_stock BOOLEAN, "
    "promo_text STRING, observed_at TIMESTAMP_NTZ, source STRING"
)
CAMPAIGNS = (
    "campaign_id BIGINT, seller_id BIGINT, product_id BIGINT, title STRING, "
    "description STRING, discount_text STRING, starts_at TIMESTAMP_NTZ, "
    "ends_at TIMESTAMP_NTZ, source_url STRING, discovered_at TIMESTAMP_NTZ"
)
DEVELOPMENTS = (
    "development_id BIGINT, seller_id BIGINT, title STRING, summary STRING, url STRING, "
    "category STRING, event_date TIMESTAMP_NTZ, discovered_at TIMESTAMP_NTZ, "
    "embedding ARRAY<FLOAT>"
)
SWOT_ANALYSES = (
    "swot_id BIGINT, seller_id BIGINT, strengths ARRAY<STRING>, weaknesses ARRAY<STRING>, "
    "opportunities ARRAY<STRING>, threats ARRAY<STRING>, generated_at TIMESTAMP_NTZ, "
    "model_used STRING, source_summary STRING"
)
CRAWL_RUNS = (
    "run_id BIGINT, seller_id BIGINT, started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ, "
    "status STRING, pages_fetched BIGINT"
)

# One parsed page: elements in document order plus the page's text pieces.
# ``first_text``/``last_text`` delimit an element's own pieces, so the text of
# any subtree is a slice. ``raw`` is set for script elements only.
PAGE_NODE = (
    "STRUCT<id: INT, end: INT, parent: INT, depth: INT, tag: STRING, "
    "attrs: MAP<STRING, STRING>, scope: INT, first_text: INT, last_text: INT, raw: STRING>"
)
PAGE_TREE = f"STRUCT<nodes: ARRAY<{PAGE_NODE}>, texts: ARRAY<STRING>, error: STRING>"

EXTRACTED_PRODUCT = (
    "STRUCT<sku: STRING, name: STRING, price: DECIMAL(18,4), original_price: DECIMAL(18,4), "
    "currency: STRING, in_stock: BOOLEAN, promo_text: STRING, category: STRING, brand: STRING, "
    "description: STRING, image_url: STRING, url: STRING, attributes: MAP<STRING, STRING>, "
    "source: STRING>"
)

"""Registered seller, listing, promotion and activity queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.text import age_label
from ..operators import campaigns as C, prices as P, sellers as S
from ..session import scratch_path
from ..sources import sinks
from .tables import AS_OF, OBSERVATION_ORDER, oracle, portable, view

_NEWEST = "row_number() OVER (ORDER BY discovered_at DESC, campaign_id DESC) AS position"
_OBS_DESC = ", ".join(f"{c} DESC" for c in OBSERVATION_ORDER)

# Registry rows: one per supplier, active when its balance is not negative.
_REGISTRY = """
    SELECT lower(replace(s_name, '#', '-')) AS slug, s_name AS name,
           'https://' || lower(replace(s_name, '#', '-')) || '.example' AS website_url,
           s_acctbal >= 0 AS active
    FROM {supplier}"""
# Own-brand registry: the first sellers by brand number, one new brand per region.
_OWN_BRANDS = """
    SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS slug, 'renamed ' || p_brand AS name,
           CAST(substr(p_brand, 7) AS INT) AS brand_num
    FROM {part} WHERE CAST(substr(p_brand, 7) AS INT) <= 5
    UNION ALL
    SELECT 'region-' || lower(r_name), r_name, 100 + r_regionkey FROM {region}"""
# Spellings a person might type for a seller.
_GUESSES = """
    SELECT p_brand AS guess FROM {part}
    UNION ALL SELECT lower(replace(p_brand, '#', '-')) FROM {part}
    UNION ALL SELECT ' ' || upper(replace(p_brand, '#', ' ')) || ' ' FROM {part}
    UNION ALL SELECT replace(p_brand, '#', '_') FROM {part}
    UNION ALL SELECT substr(p_brand, 2) FROM {part}
    UNION ALL SELECT n_name FROM {nation}"""


def _sql(spark, sf_dir, sql):
    names = [t for t in ("supplier", "part", "region", "nation") if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: view(spark, sf_dir, t) for t in names})


def _plain(sql):
    return sql.format(supplier="supplier", part="part", region="region", nation="nation")


def registry_active(spark, sf_dir):
    return S.active_only(_sql(spark, sf_dir, _REGISTRY))


def seed_sellers(spark, sf_dir):
    existing = view(spark, sf_dir, "sellers").select("seller_id", "slug", "name")
    return _new_ids_hidden(S.seed_sellers(_sql(spark, sf_dir, _REGISTRY), existing))


def _new_ids_hidden(sellers, known=25):
    """New ids are arbitrary: shown as null with whether they are there and used once."""
    is_new = F.col("seller_id") > known
    uses = sellers.groupBy("seller_id").agg(F.count(F.lit(1)).alias("uses"))
    return sellers.join(uses, "seller_id", "left").select(
        *[c for c in sellers.columns if c != "seller_id"],
        F.when(~is_new, F.col("seller_id")).alias("seller_id"),
        F.coalesce(F.col("uses") == 1, F.lit(False)).alias("has_own_id"),
    )


def upsert_own_brands(spark, sf_dir):
    sellers = view(spark, sf_dir, "sellers").withColumn("brand_num", F.lit(None).cast("int"))
    return _new_ids_hidden(S.upsert_own_brands(sellers, _sql(spark, sf_dir, _OWN_BRANDS)))


def seller_by_slug(spark, sf_dir):
    return S.by_slug(view(spark, sf_dir, "sellers"), "brand-7")


def product_by_id(spark, sf_dir):
    return S.product_by_id(view(spark, sf_dir, "products"), 42)


def product_counts(spark, sf_dir):
    return S.product_counts(view(spark, sf_dir, "products"))


def latest_crawl(spark, sf_dir):
    return S.latest_crawl(view(spark, sf_dir, "crawl_runs"))


def _overview(spark, sf_dir):
    return S.seller_overview(
        view(spark, sf_dir, "sellers"),
        view(spark, sf_dir, "products"),
        view(spark, sf_dir, "crawl_runs"),
    )


def seller_overview(spark, sf_dir):
    return _overview(spark, sf_dir)


def dashboard_stats(spark, sf_dir):
    return S.dashboard_stats(_overview(spark, sf_dir))


def crawl_age(spark, sf_dir):
    runs = view(spark, sf_dir, "crawl_runs")
    moment = F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")
    return runs.select("run_id", age_label(F.col("started_at"), moment).alias("age"))


def latest_price_page(spark, sf_dir):
    page = S.product_page(
        view(spark, sf_dir, "products"),
        view(spark, sf_dir, "observations"),
        OBSERVATION_ORDER,
        seller_id=3,
        limit=50,
        offset=10,
    )
    return portable(page)


def product_page_total(spark, sf_dir):
    return S.page_totals(view(spark, sf_dir, "products"), page=2, per_page=50)


def product_filter(spark, sf_dir):
    return S.filter_products(view(spark, sf_dir, "products"), " sKu1 ")


def product_sort(spark, sf_dir):
    listing = S.product_page(
        view(spark, sf_dir, "products"),
        view(spark, sf_dir, "observations"),
        OBSERVATION_ORDER,
        seller_id=5,
    )
    keys = [("price", True), ("price", False), ("name", False), ("category", True), ("stock", True)]
    lists = [
        S.sort_products(listing, key, down).withColumn("sorted_by", F.lit(f"{key}{' down' if down else ''}"))
        for key, down in keys
    ]
    return portable(reduce(DataFrame.unionByName, lists))


def resolve_seller(spark, sf_dir):
    return S.resolve_seller(_sql(spark, sf_dir, _GUESSES), view(spark, sf_dir, "sellers"))


def price_history_by_guess(spark, sf_dir):
    """Price history under every spelling of a seller's name."""
    guesses, sellers = _sql(spark, sf_dir, _GUESSES), view(spark, sf_dir, "sellers")
    products = S.rows_by_guess(guesses, sellers, view(spark, sf_dir, "products"))
    history = P.price_history_search(
        products, view(spark, sf_dir, "observations"), "reD", AS_OF, 3650, order=OBSERVATION_ORDER
    )
    return portable(history.select("guess", "product_id", "seller_id", "name", "price", "in_stock", "observed_at", "position"))


def campaigns_by_guess(spark, sf_dir):
    """The newest promotions under every spelling of a seller's name."""
    guesses, sellers = _sql(spark, sf_dir, _GUESSES), view(spark, sf_dir, "sellers")
    return C.search_campaigns(S.rows_by_guess(guesses, sellers, view(spark, sf_dir, "campaigns")))


def development_lines(spark, sf_dir):
    return C.development_lines(view(spark, sf_dir, "developments"))


def swot_append(spark, sf_dir):
    """Append analyses to an empty store and read the store back."""
    events = view(spark, sf_dir, "events")
    submitted = events.select(
        F.expr("CAST(user_id % 25 + 1 AS INT)").alias("seller_id"),
        F.array("event_type", "props").alias("strengths"),
        F.when(F.col("value") > 10, F.array("props")).alias("weaknesses"),
        F.array(F.col("event_id").cast("string")).alias("opportunities"),
        F.split("event_type", "e").alias("threats"),
        F.col("props").alias("source_summary"),
        "ts",
    )
    path = scratch_path(spark, "swot")
    sinks.append(S.prepare_swot(submitted, "analyst", F.col("ts")), path)
    stored = spark.read.parquet(path)
    lists = ("strengths", "weaknesses", "opportunities", "threats")
    return stored.select(
        "seller_id", "generated_at", "model_used", "source_summary",
        *[F.array_join(c, "|").alias(c) for c in lists],
    )


def swot_latest(spark, sf_dir):
    return S.swot_latest(view(spark, sf_dir, "swot_analyses"))


def swot_history(spark, sf_dir):
    return S.swot_history(view(spark, sf_dir, "swot_analyses"))


def campaign_search(spark, sf_dir):
    campaigns, products = view(spark, sf_dir, "campaigns"), view(spark, sf_dir, "products")
    everything = C.search_campaigns(campaigns).withColumn("product_query", F.lit(""))
    narrowed = C.search_campaigns(campaigns, products, "Red")
    return everything.unionByName(narrowed.withColumn("product_query", F.lit("Red")))


def campaigns_by_seller(spark, sf_dir):
    return C.campaigns_of(view(spark, sf_dir, "campaigns"), seller_id=4)


def product_campaigns(spark, sf_dir):
    return C.campaigns_of(view(spark, sf_dir, "campaigns"), product_id=17)


def campaign_lines(spark, sf_dir):
    return C.campaign_lines(view(spark, sf_dir, "campaigns"))


# Promotions seen so far come from purchases; the new batch is everything.
_SEEN = "title = 'purchase'"


def campaign_dedup_append(spark, sf_dir):
    campaigns = view(spark, sf_dir, "campaigns")
    return C.new_campaigns(campaigns, campaigns.where(_SEEN), ["discovered_at", "campaign_id"])


def developments_feed(spark, sf_dir):
    return C.developments_feed(view(spark, sf_dir, "developments").drop("embedding"))


def _submitted(spark, sf_dir):
    return view(spark, sf_dir, "developments").select(
        "development_id", "seller_id", "title", "summary",
        F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
    )


def development_append(spark, sf_dir):
    return C.prepare_developments(_submitted(spark, sf_dir)).drop("embedding_text")


def embedding_text(spark, sf_dir):
    return C.prepare_developments(_submitted(spark, sf_dir)).select(
        "development_id", "embedding_text"
    )


def campaign_append(spark, sf_dir):
    submitted = view(spark, sf_dir, "campaigns")
    for column in ("starts_at", "ends_at"):
        text = F.coalesce(F.date_format(column, "yyyy-MM-dd"), F.lit(""))
        submitted = submitted.withColumn(column, text)
    return C.prepare_campaigns(submitted)


def recent_activity(spark, sf_dir):
    return C.recent_activity(
        view(spark, sf_dir, "campaigns"),
        view(spark, sf_dir, "developments"),
        view(spark, sf_dir, "sellers"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        registry_active, seed_sellers, upsert_own_brands, seller_by_slug, product_by_id,
        product_counts, latest_crawl, seller_overview, dashboard_stats, crawl_age,
        latest_price_page, product_page_total, product_filter, product_sort, resolve_seller,
        price_history_by_guess, campaigns_by_guess, development_lines,
        swot_append, swot_latest, swot_history, campaign_search, campaigns_by_seller, product_campaigns,
        campaign_lines, campaign_dedup_append, developments_feed, development_append,
        embedding_text, campaign_append, recent_activity,
    )
}

_LABELS = " ".join(f"WHEN '{status}' THEN '{label}'" for status, label in K.STATUS_LABELS.items())
_OVERVIEW = f"""
    SELECT s.*, coalesce(c.product_count, 0) AS product_count, l.started_at AS last_crawled_at,
           l.status AS last_crawl_status,
           CASE l.status {_LABELS} END AS status_label
    FROM sellers s
    LEFT JOIN (SELECT seller_id, count(*) AS product_count FROM products GROUP BY 1) c USING (seller_id)
    LEFT JOIN (SELECT * FROM crawl_runs QUALIFY row_number() OVER
               (PARTITION BY seller_id ORDER BY started_at DESC, run_id DESC) = 1) l USING (seller_id)"""


def _page(seller, limit, offset):
    return f"""
        WITH page AS (SELECT * FROM products WHERE seller_id = {seller}
                      ORDER BY name, product_id LIMIT {limit} OFFSET {offset}),
        latest AS (SELECT * FROM observations WHERE product_id IN (SELECT product_id FROM page)
                   QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY {_OBS_DESC}) = 1)
        SELECT page.*, CAST(price AS DOUBLE) AS latest_price, currency, in_stock
        FROM page LEFT JOIN latest USING (product_id)"""


_RESOLVED = f"""
    guesses AS (SELECT DISTINCT guess FROM ({_plain(_GUESSES)})),
    matches AS (
        SELECT guess, seller_id, slug, CASE WHEN slug = guess THEN 0 ELSE 1 END AS priority
        FROM guesses JOIN sellers ON slug = guess
          OR slug ILIKE '%' || translate(lower(trim(guess)), ' _', '--') || '%'
          OR name ILIKE '%' || guess || '%'),
    resolved AS (SELECT guess, seller_id, slug FROM matches QUALIFY row_number() OVER
        (PARTITION BY guess ORDER BY priority, length(slug), slug) = 1)"""

ORACLES = {
    "registry_active": f"SELECT * FROM ({_plain(_REGISTRY)}) WHERE active",
    "seed_sellers": oracle(
        ["sellers"],
        f"""SELECT seller_id, slug, name, CAST(NULL AS VARCHAR) AS website_url, TRUE AS has_own_id FROM sellers
            UNION ALL SELECT NULL, slug, name, website_url, TRUE FROM ({_plain(_REGISTRY)}) r
            WHERE active AND slug NOT IN (SELECT slug FROM sellers)""",
    ),
    "upsert_own_brands": oracle(
        ["sellers"],
        f"""WITH own AS ({_plain(_OWN_BRANDS)})
            SELECT s.slug, s.name, s.seller_id, o.brand_num,
                   s.is_own_brand OR o.slug IS NOT NULL AS is_own_brand, TRUE AS has_own_id
            FROM sellers s LEFT JOIN own o USING (slug)
            UNION ALL SELECT slug, name, NULL, brand_num, TRUE, TRUE FROM own
            WHERE slug NOT IN (SELECT slug FROM sellers)""",
    ),
    "seller_by_slug": oracle(["sellers"], "SELECT * FROM sellers WHERE slug = 'brand-7'"),
    "product_by_id": oracle(["products"], "SELECT * FROM products WHERE product_id = 42"),
    "product_counts": oracle(
        ["products"], "SELECT seller_id, count(*) AS product_count FROM products GROUP BY 1"
    ),
    "latest_crawl": oracle(
        ["crawl_runs"],
        """SELECT * FROM crawl_runs QUALIFY row_number() OVER
           (PARTITION BY seller_id ORDER BY started_at DESC, run_id DESC) = 1""",
    ),
    "seller_overview": oracle(["sellers", "products", "crawl_runs"], _OVERVIEW),
    "dashboard_stats": oracle(
        ["sellers", "products", "crawl_runs"],
        f"""SELECT count(*) FILTER (NOT is_own_brand) AS rivals,
                   count(*) FILTER (is_own_brand) AS own_brands,
                   CAST(sum(product_count) AS BIGINT) AS total_products,
                   count(*) FILTER (last_crawl_status IN ('partial_failure', 'failed'))
                       AS needs_attention
            FROM ({_OVERVIEW})""",
    ),
    "crawl_age": oracle(
        ["crawl_runs"],
        f"""WITH aged AS (SELECT run_id, greatest(0, epoch(TIMESTAMP '{AS_OF}') - epoch(started_at))
                          AS seconds FROM crawl_runs)
            SELECT run_id, CASE WHEN seconds < 60 THEN 'just now'
                WHEN seconds < 3600 THEN CAST(floor(seconds / 60) AS BIGINT) || 'm ago'
                WHEN seconds < 86400 THEN CAST(floor(seconds / 3600) AS BIGINT) || 'h ago'
                ELSE CAST(floor(seconds / 86400) AS BIGINT) || 'd ago' END AS age FROM aged""",
    ),
    "latest_price_page": oracle(["products", "observations"], _page(3, 50, 10)),
    "product_page_total": oracle(
        ["products"],
        """SELECT seller_id, count(*) AS total, 51 AS range_start,
                  least(100, count(*)) AS range_end, TRUE AS has_prev,
                  least(100, count(*)) < count(*) AS has_next
           FROM products GROUP BY seller_id""",
    ),
    "product_filter": oracle(
        ["products"],
        """SELECT * FROM products WHERE lower(name) LIKE '%sku1%' OR lower(category) LIKE '%sku1%'
           OR lower(coalesce(sku, '')) LIKE '%sku1%'""",
    ),
    "product_sort": oracle(
        ["products", "observations"],
        f"""WITH listing AS ({_page(5, 50, 0)}),
            keys(sorted_by) AS (VALUES ('price down'), ('price'), ('name'), ('category down'), ('stock down'))
            SELECT listing.*, sorted_by, row_number() OVER (PARTITION BY sorted_by ORDER BY
                CASE WHEN sorted_by = 'price down' THEN latest_price END DESC NULLS LAST,
                CASE WHEN sorted_by = 'price' THEN latest_price END ASC NULLS FIRST,
                CASE WHEN sorted_by = 'category down' THEN category END DESC NULLS LAST,
                CASE WHEN sorted_by = 'stock down' THEN coalesce(in_stock, FALSE) END DESC NULLS LAST,
                name, product_id) AS position
            FROM listing, keys""",
    ),
    "resolve_seller": oracle(["sellers"], f"WITH {_RESOLVED} SELECT * FROM resolved"),
    "price_history_by_guess": oracle(
        ["sellers", "products", "observations"],
        f"""WITH {_RESOLVED}
            SELECT guess, product_id, seller_id, name, CAST(price AS DOUBLE) AS price, in_stock, observed_at,
                   row_number() OVER (PARTITION BY guess ORDER BY name, {", ".join(OBSERVATION_ORDER)}, product_id) AS position
            FROM resolved JOIN products USING (seller_id) JOIN observations USING (product_id)
            WHERE name ILIKE '%ReD%' AND observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3650 DAY""",
    ),
    "campaigns_by_guess": oracle(
        ["sellers", "campaigns"],
        f"""WITH {_RESOLVED}
            SELECT guess, c.*, row_number() OVER (PARTITION BY guess ORDER BY discovered_at DESC, campaign_id DESC) AS rank_no
            FROM resolved JOIN campaigns c USING (seller_id) QUALIFY rank_no <= 20""",
    ),
    "development_lines": oracle(
        ["developments"],
        """SELECT development_id, '[' || category || '] ' || title || ' (' || strftime(event_date, '%Y-%m-%d') || '): '
               || summary AS line FROM developments""",
    ),
    "swot_append": """
        SELECT CAST(user_id % 25 + 1 AS INT) AS seller_id, ts AS generated_at,
               'analyst' AS model_used, props AS source_summary,
               event_type || '|' || props AS strengths,
               CASE WHEN value > 10 THEN props ELSE '' END AS weaknesses,
               CAST(event_id AS VARCHAR) AS opportunities, replace(event_type, 'e', '|') AS threats
        FROM events""",
    "swot_latest": oracle(
        ["swot_analyses"],
        """SELECT * FROM swot_analyses QUALIFY row_number() OVER
           (PARTITION BY seller_id ORDER BY generated_at DESC, swot_id DESC) = 1""",
    ),
    "swot_history": oracle(["swot_analyses"], "SELECT *, row_number() OVER (ORDER BY generated_at DESC, swot_id DESC) AS position FROM swot_analyses"),
    "campaign_search": oracle(
        ["campaigns", "products"],
        """WITH both_ways AS (
               SELECT c.*, '' AS product_query FROM campaigns c
               UNION ALL
               SELECT c.*, 'Red' FROM campaigns c LEFT JOIN products p USING (product_id)
               WHERE p.name ILIKE '%Red%')
           SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_query, seller_id
                          ORDER BY discovered_at DESC, campaign_id DESC) AS rank_no FROM both_ways)
           WHERE rank_no <= 20""",
    ),
    "campaigns_by_seller": oracle(["campaigns"], f"SELECT *, {_NEWEST} FROM campaigns WHERE seller_id = 4"),
    "product_campaigns": oracle(["campaigns"], f"SELECT *, {_NEWEST} FROM campaigns WHERE product_id = 17"),
    "campaign_lines": oracle(
        ["campaigns"],
        """SELECT campaign_id, title || ' — ' || discount_text
               || CASE WHEN starts_at IS NULL AND ends_at IS NULL THEN ''
                       ELSE ' (' || coalesce(strftime(starts_at, '%Y-%m-%d'), '?') || ' to '
                            || coalesce(strftime(ends_at, '%Y-%m-%d'), '?') || ')' END
               || ': ' || description AS line
           FROM campaigns""",
    ),
    "campaign_dedup_append": oracle(
        ["campaigns"],
        f"""SELECT * FROM campaigns n
            WHERE NOT EXISTS (SELECT 1 FROM campaigns s WHERE s.{_SEEN}
                AND s.seller_id = n.seller_id AND s.product_id IS NOT DISTINCT FROM n.product_id
                AND s.discount_text = n.discount_text)
            QUALIFY row_number() OVER (PARTITION BY seller_id, product_id, discount_text
                                       ORDER BY discovered_at, campaign_id) = 1""",
    ),
    "developments_feed": oracle(["developments"], """SELECT * EXCLUDE (embedding), row_number() OVER (ORDER BY event_date DESC, development_id DESC) AS position
           FROM developments"""),
    "development_append": oracle(
        ["developments"],
        """SELECT development_id, seller_id, title, summary,
                  date_trunc('day', event_date)::TIMESTAMP AS event_date FROM developments""",
    ),
    "embedding_text": oracle(
        ["developments"],
        "SELECT development_id, title || chr(10) || summary AS embedding_text FROM developments",
    ),
    "campaign_append": oracle(
        ["campaigns"],
        """SELECT * REPLACE (date_trunc('day', starts_at)::TIMESTAMP AS starts_at,
                             date_trunc('day', ends_at)::TIMESTAMP AS ends_at) FROM campaigns""",
    ),
    "recent_activity": oracle(
        ["campaigns", "developments", "sellers"],
        """WITH items AS (
               SELECT 'campaign' AS kind, campaign_id AS id, seller_id, title, description AS detail,
                      discovered_at AS "at", discount_text, NULL AS category FROM campaigns
               UNION ALL
               SELECT 'development', development_id, seller_id, title, summary, discovered_at, NULL,
                      category FROM developments)
           SELECT i.*, s.slug AS seller_slug, s.name AS seller_name
           FROM items i JOIN sellers s USING (seller_id) ORDER BY "at" DESC, kind, id DESC LIMIT 12""",
    ),
}

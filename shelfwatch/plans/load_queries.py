"""Registered feed, matching, pagination, crawl and trace queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prices as P
from ..functions.text import price_context as price_context_of
from .. import schemas
from ..operators import feed_import as I, matching as M, pagination as G, sellers as S, traces as T
from ..sources import feed as feeds, sinks
from ..session import delete_folder, discard, lean_scratch, materialise, parts_of, scratch_path, spread
from .tables import OBSERVATION_ORDER, oracle, portable, view

_FEED_ORDER = ("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
_ITEM_ORDER = ["crawl", "page_idx", "pos", "l_shipdate"]
_CHAIN = [  # items about one known product n without a sku
    (1, "A", "n"), (2, "A", "x"), (3, "B", "x"), (4, None, "y"), (5, "C", "y"), (6, "C", "z"), (7, "B", "n"), (8, "D", "n"),
]
_CSV_LINE = """concat_ws(',', sku, brand_num, category, '"' || name || '"', grade, season, price)"""


def _lines(spark, sf_dir):
    rows = view(spark, sf_dir, "feed_rows")
    return spread(rows.select(F.expr(_CSV_LINE).alias("line"), *_FEED_ORDER))


def _feed(spark, sf_dir):
    return feeds.parse_feed(feeds.parse_lines(_lines(spark, sf_dir)))


def _sellers(spark, sf_dir, own=7):
    brand = F.when(F.col("seller_id") <= own, F.col("seller_id")).alias("brand_num")
    return view(spark, sf_dir, "sellers").select("seller_id", "slug", brand)


def feed_parse(spark, sf_dir):
    return portable(_feed(spark, sf_dir))


def feed_rejects(spark, sf_dir):
    """Rows with a truncated season or a worded price, as a careless export gives them."""
    raw = (
        view(spark, sf_dir, "feed_rows")
        .withColumn("season", F.expr("CASE WHEN l_suppkey = 3 THEN substr(season, 1, 2) ELSE season END"))
        .withColumn("price", F.expr("CASE WHEN l_suppkey = 5 THEN 'call us' ELSE price END"))
        .withColumn("brand_num", F.expr("CASE WHEN l_suppkey = 7 THEN 'x' ELSE brand_num END"))
    )
    return feeds.rejects(raw).select("sku", "reason", *_FEED_ORDER)


def feed_unknown_brand(spark, sf_dir):
    return portable(I.unknown_brands(_feed(spark, sf_dir), _sellers(spark, sf_dir, own=5)))


def feed_new_products(spark, sf_dir):
    placed = I.with_seller(_feed(spark, sf_dir), _sellers(spark, sf_dir))
    known = view(spark, sf_dir, "known_feed_products")
    return I.new_products(placed, known, list(_FEED_ORDER))


def _write_feed(spark, sf_dir, path):
    """The feed's lines in order, in folders of ``path``: one for each range of orders that is sorted at a time."""
    rows, first = view(spark, sf_dir, "feed_rows"), _FEED_ORDER[0]
    orders = view(spark, sf_dir, "lineitem")
    parts = parts_of(orders)
    cuts = orders.approxQuantile(first, [n / parts for n in range(1, parts)], 0.01) if parts > 1 else []
    cuts = sorted({int(c) for c in cuts})
    for n, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        some = rows if low is None else rows.where(F.col(first) >= low)
        if high is not None:
            below = F.col(first) < high
            some = some.where(below | F.col(first).isNull() if low is None else below)
        lines = some.orderBy(*_FEED_ORDER).select(F.expr(_CSV_LINE).alias("value"))
        lines.write.option("compression", "gzip").text(f"{path}/{n:03d}")


def import_first_run(spark, sf_dir):
    """A first import from a CSV file into empty tables, brands included, then the same file again.

    Shown by seller slug and sku; ``run`` 2 has rows only if the second import added any.
    """
    path = scratch_path(spark, "feed")
    with lean_scratch(spark):
        _write_feed(spark, sf_dir, path)
        feed = materialise(feeds.parse_feed(feeds.read_feed(spark, f"{path}/*")), "parsed-feed")  # both imports read it
        delete_folder(spark, path)
        brands = [(k, f"own-{k}", f"Own {k}") for k in range(1, 8)]
        own = spark.createDataFrame(brands, "brand_num INT, slug STRING, name STRING")
        sellers = materialise(S.upsert_own_brands(spark.createDataFrame([], schemas.SELLERS), own), "sellers")
        products, stored = (spark.createDataFrame([], t) for t in (schemas.PRODUCTS, schemas.OBSERVATIONS))
        runs = []
        for run in (1, 2):
            added, fresh = I.import_feed(feed, sellers, products, stored, ("row_order",), True, True)
            before, products = products, materialise(products.unionByName(added, allowMissingColumns=True), "products")
            discard(before)
            discard(added)
            stored = stored.unionByName(fresh)
            runs.append(fresh.withColumn("run", F.lit(run)))
        discard(feed)
    shown = runs[0].unionByName(runs[1]).join(products.select("product_id", "seller_id", "sku"), "product_id")
    return portable(shown.join(sellers.select("seller_id", "slug"), "seller_id").drop("product_id", "seller_id"))


def feed_import(spark, sf_dir):
    """The import's observations, shown by seller and sku because new ids are arbitrary."""
    known = view(spark, sf_dir, "known_feed_products")
    stored = spark.createDataFrame([], "product_id BIGINT, observed_at TIMESTAMP_NTZ, source STRING")
    added, readings = I.import_feed(
        _feed(spark, sf_dir), _sellers(spark, sf_dir), known, stored, _FEED_ORDER
    )
    keys = known.select("product_id", "seller_id", "sku", F.lit(False).alias("is_new")).unionByName(
        added.select("product_id", "seller_id", "sku", F.lit(True).alias("is_new"))
    )
    return portable(readings.join(keys, "product_id").drop("product_id"))


def _stored(observations):
    return observations.where("currency = 'USD' AND l_linenumber <= 3")


def feed_idempotent_append(spark, sf_dir):
    observations = view(spark, sf_dir, "observations")
    fresh = sinks.new_observations(
        observations, _stored(observations), ["l_orderkey", "l_linenumber", "l_suppkey"]
    )
    return portable(fresh)


def observations_append(spark, sf_dir):
    """Append all observations to an empty store and read the store back."""
    path = scratch_path(spark, "observations")
    sinks.append_observations(view(spark, sf_dir, "observations"), path)
    return portable(sinks.read_observations(spark, path))


def _items(spark, sf_dir):
    return view(spark, sf_dir, "page_items")


def product_match(spark, sf_dir):
    placed = M.match_products(_items(spark, sf_dir), view(spark, sf_dir, "known_products"))
    return placed.select("crawl", "page_idx", "pos", "seller_id", "sku", "name", "product_id")


def product_upsert(spark, sf_dir):
    """Products after a crawl; new ids are arbitrary, so they are left out."""
    _, after = M.find_or_create(
        _items(spark, sf_dir), view(spark, sf_dir, "known_products"), _ITEM_ORDER
    )
    old_id = F.when(~F.col("is_new"), F.col("product_id"))
    return after.withColumn("product_id", old_id)


def product_upsert_chain(spark, sf_dir):
    """The product of each item, where items fill skus and later ones of other names carry them."""
    part = view(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    products = part.select(
        F.col("p_partkey").cast("bigint").alias("product_id"), F.expr("p_partkey % 5").alias("seller_id"),
        F.lit(None).cast("string").alias("sku"), F.concat(F.lit("n"), key).alias("name"),
        F.lit("").alias("category"), F.lit("").alias("url"),
    )
    steps = spark.createDataFrame(_CHAIN, "step INT, sku STRING, name STRING")
    items = products.drop("sku", "name").crossJoin(F.broadcast(steps)).select(
        F.col("product_id").alias("p_partkey"), "step", "seller_id", "category", "url",
        F.concat("sku", F.col("product_id").cast("string")).alias("sku"),
        F.concat("name", F.col("product_id").cast("string")).alias("name"),
    )
    placed, after = M.find_or_create(items, products, ["step", "p_partkey"])
    own = after.select("product_id", F.col("name").alias("product"), F.col("sku").alias("product_sku"))
    return placed.join(own, "product_id").select("p_partkey", "step", "product", "product_sku")


def promo_text(spark, sf_dir):
    lines = view(spark, sf_dir, "lineitem")
    price = (F.col("l_extendedprice") - 0).cast("decimal(12,2)")
    original = F.when(
        F.col("l_discount") > 0.02, F.col("l_quantity").cast("decimal(12,2)")
    )
    promo = F.when(F.col("l_returnflag") == "A", "Deal").otherwise("")
    text = P.promo_text(promo, F.lit("USD"), original, price)
    return lines.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", text.alias("promo_text"))


def multipass_merge(spark, sf_dir):
    rows = _items(spark, sf_dir).select(
        F.col("crawl").alias("page"), "name", F.col("page_idx").alias("pass_no"), "pos",
        "l_partkey", "l_shipdate", "price",
    )
    return portable(G.merge_passes(rows, ["pass_no", "pos", "l_partkey", "l_shipdate"]))


def new_items_per_page(spark, sf_dir):
    items = _items(spark, sf_dir).select("crawl", "page_idx", "name", "l_partkey", "pos")
    return G.first_seen(items, "name")


def _links(items):
    return items.select(
        "crawl", "page_idx", F.concat(F.lit("/products/"), F.col("pos").cast("string")).alias("url")
    )


def new_links_per_page(spark, sf_dir):
    return G.new_per_page(_links(_items(spark, sf_dir)), "url", "new_links")


def _page_texts(spark, sf_dir):
    """Conversation turns as listing pages, each sentence end priced."""
    return view(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("crawl"),
        F.col("turn").alias("page_idx"),
        F.replace("text", F.lit("."), F.lit(" $19.99")).alias("text"),
    )


def price_context(spark, sf_dir):
    pages = _page_texts(spark, sf_dir)
    return pages.select("crawl", "page_idx", price_context_of(F.col("text")).alias("context"))


def recycled_pages(spark, sf_dir):
    return G.recycled_pages(_page_texts(spark, sf_dir))


# Every third crawl shows one and the same price from its third page on.
_PAGES = """
    SELECT DISTINCT crawl, page_idx, '/list/' || CAST(page_idx % 5 AS STRING) AS url,
           CASE WHEN (crawl + page_idx) % 4 <> 0 THEN '/list/next' END AS next_url,
           CASE WHEN crawl % 3 = 0 AND page_idx > 2 THEN 'same offer $5 for all'
                ELSE 'crawl ' || CAST(crawl AS STRING) || ' costs $' || CAST(page_idx * 1111 AS STRING) END AS text
    FROM {page_items}"""


def pagination_stop(spark, sf_dir):
    items = materialise(_items(spark, sf_dir).select("crawl", "page_idx", "pos", "name"), "page-items")
    pages = spark.sql(_PAGES, page_items=items.select("crawl", "page_idx").distinct())
    pages = pages.withColumn("context", price_context_of(F.col("text")))
    pages = materialise(pages.drop("text"), "listing-pages")
    return G.pagination_stop(pages, items.select("crawl", "page_idx", "name"), _links(items))


_UNITS = """
    SELECT l_orderkey AS run_id,
           CASE l_linenumber WHEN 1 THEN 'homepage' WHEN 2 THEN 'category' WHEN 3 THEN 'promo'
                WHEN 7 THEN 'discovery' ELSE 'product' END AS kind,
           '/p/' || CAST(l_partkey AS STRING) AS url,
           CASE WHEN l_returnflag = 'R' THEN 'timeout' END AS error,
           l_linestatus = 'F' OR l_returnflag <> 'R' AS fetched
    FROM {lineitem}"""


def crawl_run_rollup(spark, sf_dir):
    return G.crawl_outcome(spark.sql(_UNITS, lineitem=view(spark, sf_dir, "lineitem")))


def crawl_error_log(spark, sf_dir):
    return G.crawl_errors(spark.sql(_UNITS, lineitem=view(spark, sf_dir, "lineitem")))


_MESSAGES = """
    SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN 'tool' ELSE 'request' END AS kind,
           CASE role WHEN 'system' THEN 'save_swot_analysis' WHEN 'user' THEN 'search_campaigns'
                ELSE 'query_price_history' END AS name
    FROM {conversations}"""
_ROUTES = """
    SELECT DISTINCT conv_id, CASE conv_id % 3 WHEN 0 THEN 'swot' WHEN 1 THEN 'developments'
                                  ELSE 'general' END AS route
    FROM {conversations}"""


def _tools(spark, sf_dir):
    conversations = view(spark, sf_dir, "conversations")
    return T.tools_used(spark.sql(_MESSAGES, conversations=conversations))


def first_use_order(spark, sf_dir):
    tools = _tools(spark, sf_dir)
    return tools.select("conv_id", F.array_join("tools", ",").alias("tools"))


def required_step_check(spark, sf_dir):
    routes = spark.sql(_ROUTES, conversations=view(spark, sf_dir, "conversations"))
    traces = routes.join(_tools(spark, sf_dir), "conv_id", "left")
    return T.required_step(traces).select("conv_id", "route", "save_verified")


def text_blocks(spark, sf_dir):
    """Turns wrapped as block lists or plain JSON strings, then read back."""
    turns = view(spark, sf_dir, "conversations")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    cut = F.floor(F.length("text") / 2).cast("int")
    listed = F.to_json(
        F.array(
            block("thinking", F.lit("...")),
            block("text", F.left("text", cut)),
            block("tool_use", F.lit("x")),
            block("text", F.expr("substring(text, floor(length(text) / 2) + 1)")),
        )
    )
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    content = F.when(F.col("role") == "user", quoted).otherwise(listed)
    return turns.select("conv_id", "turn", T.message_text(content).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        feed_parse, feed_rejects, feed_unknown_brand, feed_new_products, feed_import, import_first_run,
        feed_idempotent_append, observations_append, product_match, product_upsert, product_upsert_chain,
        promo_text, multipass_merge, new_items_per_page, new_links_per_page, price_context, recycled_pages,
        pagination_stop, crawl_run_rollup, crawl_error_log, first_use_order, required_step_check,
        text_blocks,
    )
}

_PARSED = """
    parsed AS (
        SELECT sku, CAST(brand_num AS INT) AS brand_num, category, trim(name) AS name, grade,
               make_timestamp(2000 + CAST(substr(season, 2) AS BIGINT),
                              CASE WHEN upper(season[1]) = 'S' THEN 3 ELSE 9 END, 1, 0, 0, 0)
                   AS observed_at,
               CASE WHEN price <> 'NULL' THEN CAST(price AS DOUBLE) END AS price,
               l_orderkey, l_linenumber, l_suppkey, l_shipdate
        FROM feed_rows)"""
_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_shipdate"
_ITEMS_BY = "crawl, page_idx, pos, l_shipdate"
_MATCHED = """
    sku_ids AS (SELECT seller_id, sku, min(product_id) AS id FROM known_products
                WHERE sku IS NOT NULL GROUP BY ALL),
    name_ids AS (SELECT seller_id, name, min(product_id) AS id FROM known_products GROUP BY ALL),
    matched AS (
        SELECT i.*, coalesce(s.id, n.id) AS product_id FROM page_items i
        LEFT JOIN sku_ids s ON s.seller_id = i.seller_id AND s.sku = i.sku
        LEFT JOIN name_ids n ON n.seller_id = i.seller_id AND n.name = i.name)"""



def _runs(source, text, keep):
    """Distinct runs of eight characters of the price contexts of ``text``."""
    return f"""
        SELECT {keep}, CASE WHEN context = '' THEN [] ELSE list_distinct(list_transform(
                   range(1, greatest(length(context) - 7, 1) + 1), lambda i: substring(context, i, 8))) END AS runs
        FROM (SELECT {keep}, array_to_string(list_transform(
                  list_filter(range(1, length({text}) + 1), lambda i: {text}[i] = '$'), lambda i:
                  substring({text}, greatest(1, i - 40), i - greatest(1, i - 40) + 40)), ' ') AS context
              FROM {source})"""


def _scored(runs, crawl, number, keep):
    """Similarity of every page to the one before it."""
    shared = "len(list_intersect(b.runs, r.runs))"
    both = "(len(b.runs) + len(r.runs))"
    return f"""
        SELECT {", ".join("r." + c.strip() for c in keep.split(","))}, CASE WHEN b.runs IS NOT NULL THEN
                   CASE WHEN {both} = 0 THEN 1.0::DOUBLE ELSE 2 * {shared} / {both} END END AS similarity
        FROM {runs} r LEFT JOIN {runs} b ON b.{crawl} = r.{crawl} AND b.{number} = r.{number} - 1"""


ORACLES = {
    "recycled_pages": f"""
        WITH t AS (SELECT conv_id AS crawl, turn AS page_idx, replace(text, '.', ' $19.99') AS x,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_no FROM conversations),
        runs AS ({_runs("t", "x", "crawl, page_idx, page_no")}),
        scored AS ({_scored("runs", "crawl", "page_no", "crawl, page_idx")})
        SELECT crawl, page_idx, similarity, coalesce(similarity > 0.5, FALSE) AS is_recycled FROM scored""",
    "feed_parse": oracle(["feed_rows"], f"WITH {_PARSED} SELECT * FROM parsed"),
    "feed_rejects": oracle(
        ["feed_rows"],
        """SELECT sku, CASE l_suppkey WHEN 3 THEN 'unrecognised season code: ' || substr(season, 1, 2)
                    WHEN 5 THEN 'unparseable price: call us' ELSE 'bad brand number: x' END AS reason,
                  l_orderkey, l_linenumber, l_suppkey, l_shipdate
           FROM feed_rows WHERE l_suppkey IN (3, 5, 7)""",
    ),
    "feed_unknown_brand": oracle(
        ["feed_rows"], f"WITH {_PARSED} SELECT * FROM parsed WHERE brand_num > 5"
    ),
    "feed_new_products": oracle(
        ["feed_rows", "known_feed_products"],
        f"""WITH {_PARSED}
            SELECT brand_num AS seller_id, sku, name, grade, category, '' AS url FROM parsed p
            WHERE NOT EXISTS (SELECT 1 FROM known_feed_products k
                              WHERE k.seller_id = p.brand_num AND k.sku = p.sku)
            QUALIFY row_number() OVER (PARTITION BY brand_num, sku ORDER BY {_ORDER}) = 1""",
    ),
    "feed_import": oracle(
        ["feed_rows", "known_feed_products"],
        f"""WITH {_PARSED}
            SELECT brand_num AS seller_id, sku, price, 'USD' AS currency,
                   price IS NOT NULL AS in_stock, '' AS promo_text, observed_at,
                   'internal_feed' AS source,
                   NOT EXISTS (SELECT 1 FROM known_feed_products k
                               WHERE k.seller_id = p.brand_num AND k.sku = p.sku) AS is_new
            FROM parsed p
            QUALIFY row_number() OVER (PARTITION BY brand_num, sku, observed_at ORDER BY {_ORDER}) = 1""",
    ),
    "import_first_run": oracle(
        ["feed_rows"],
        f"""WITH {_PARSED}
            SELECT 'own-' || brand_num AS slug, sku, price, 'USD' AS currency,
                   price IS NOT NULL AS in_stock, '' AS promo_text, observed_at,
                   'internal_feed' AS source, 1 AS run
            FROM parsed
            QUALIFY row_number() OVER (PARTITION BY brand_num, sku, observed_at ORDER BY {_ORDER}) = 1""",
    ),
    "feed_idempotent_append": oracle(
        ["observations"],
        """SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM (
               SELECT * FROM observations WHERE source <> 'internal_feed'
               UNION ALL
               (SELECT * FROM observations o WHERE source = 'internal_feed'
                  AND NOT EXISTS (SELECT 1 FROM observations s WHERE s.product_id = o.product_id
                      AND s.observed_at = o.observed_at AND s.source = 'internal_feed'
                      AND s.l_linenumber <= 3)
                QUALIFY row_number() OVER (PARTITION BY product_id, observed_at
                    ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1))""",
    ),
    "observations_append": oracle(
        ["observations"], "SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM observations"
    ),
    "product_match": oracle(
        ["page_items", "known_products"],
        f"""WITH {_MATCHED}
            SELECT crawl, page_idx, pos, seller_id, sku, name, product_id FROM matched""",
    ),
    "product_upsert": oracle(
        ["page_items", "known_products"],
        f"""WITH {_MATCHED},
            created AS (
                SELECT seller_id, sku, name, 1000000000 + row_number() OVER (ORDER BY {_ITEMS_BY})
                           AS product_id
                FROM matched WHERE product_id IS NULL
                QUALIFY row_number() OVER (PARTITION BY seller_id, name ORDER BY {_ITEMS_BY}) = 1),
            placed AS (
                SELECT m.* REPLACE (coalesce(m.product_id, s.product_id, n.product_id) AS product_id)
                FROM matched m
                LEFT JOIN created s ON s.seller_id = m.seller_id AND s.sku = m.sku
                LEFT JOIN created n ON n.seller_id = m.seller_id AND n.name = m.name),
            news AS (
                SELECT product_id,
                       arg_max(category, ({_ITEMS_BY})) FILTER (category <> '') AS new_category,
                       arg_max(url, ({_ITEMS_BY})) AS new_url,
                       arg_min(sku, ({_ITEMS_BY})) FILTER (sku IS NOT NULL) AS new_sku
                FROM placed GROUP BY product_id),
            every AS (
                SELECT product_id, seller_id, sku, name, category, url, FALSE AS is_new
                FROM known_products
                UNION ALL SELECT product_id, seller_id, sku, name, '', '', TRUE FROM created)
            SELECT CASE WHEN NOT is_new THEN every.product_id END AS product_id, seller_id,
                   coalesce(sku, new_sku) AS sku, name, coalesce(new_category, category) AS category,
                   coalesce(new_url, url) AS url, is_new, news.product_id IS NOT NULL AS seen
            FROM every LEFT JOIN news ON news.product_id = every.product_id""",
    ),
    "product_upsert_chain": """
        SELECT p_partkey, step, product || CAST(p_partkey AS VARCHAR) AS product,
               sku || CAST(p_partkey AS VARCHAR) AS product_sku
        FROM part, (VALUES (1, 'n', 'A'), (2, 'n', 'A'), (3, 'x', 'B'), (4, 'y', 'C'), (5, 'y', 'C'),
                           (6, 'y', 'C'), (7, 'x', 'B'), (8, 'n', 'A')) AS t(step, product, sku)""",
    "promo_text": """
        WITH p AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'Deal' ELSE '' END AS promo,
                          CASE WHEN l_discount > 0.02 THEN CAST(l_quantity AS DECIMAL(12,2)) END AS original,
                          CAST(l_extendedprice AS DECIMAL(12,2)) AS price FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
               CASE WHEN original IS NULL OR original = price THEN promo
                    WHEN promo = '' THEN 'Was USD ' || CAST(original AS VARCHAR)
                    ELSE promo || '; Was USD ' || CAST(original AS VARCHAR) END AS promo_text
        FROM p""",
    "multipass_merge": oracle(
        ["page_items"],
        """SELECT crawl AS page, name, page_idx AS pass_no, pos, l_partkey, l_shipdate,
                  CAST(price AS DOUBLE) AS price FROM page_items
           QUALIFY row_number() OVER (PARTITION BY crawl, name
               ORDER BY price IS NULL, page_idx, pos, l_partkey, l_shipdate) = 1""",
    ),
    "new_items_per_page": oracle(
        ["page_items"],
        """SELECT crawl, page_idx, name, l_partkey, pos FROM page_items
           QUALIFY page_idx = min(page_idx) OVER (PARTITION BY crawl, name)""",
    ),
    "new_links_per_page": oracle(
        ["page_items"],
        """SELECT crawl, page_idx, count(*) AS new_links FROM (
               SELECT crawl, pos, min(page_idx) AS page_idx FROM page_items GROUP BY ALL)
           GROUP BY ALL""",
    ),
    "price_context": """
        WITH t AS (SELECT conv_id, turn, replace(text, '.', ' $19.99') AS x FROM conversations),
        spots AS (SELECT *, list_filter(range(1, length(x) + 1), lambda i: x[i] = '$') AS at_chars FROM t)
        SELECT conv_id AS crawl, turn AS page_idx,
               coalesce(array_to_string(list_transform(at_chars, lambda i:
                   substring(x, greatest(1, i - 40), i - greatest(1, i - 40) + 40)), ' '), '') AS context
        FROM spots""",
    "pagination_stop": oracle(
        ["page_items"],
        f"""WITH pages AS ({_PAGES.format(page_items="page_items")}),
            listing AS (SELECT *, row_number() OVER (PARTITION BY crawl ORDER BY page_idx) AS page_no,
                               row_number() OVER (PARTITION BY crawl, url ORDER BY page_idx) > 1 AS again
                        FROM pages),
            i AS (SELECT crawl, page_idx, count(*) AS n FROM (
                      SELECT crawl, name, min(page_idx) AS page_idx FROM page_items GROUP BY ALL) GROUP BY ALL),
            l AS (SELECT crawl, page_idx, count(*) AS n FROM (
                      SELECT crawl, pos, min(page_idx) AS page_idx FROM page_items GROUP BY ALL) GROUP BY ALL),
            runs AS ({_runs("listing", "text", "crawl, page_idx, page_no")}),
            scored AS ({_scored("runs", "crawl", "page_no", "crawl, page_idx")}),
            flagged AS (
                SELECT p.crawl, p.page_idx, page_no, coalesce(i.n, 0) AS new_items,
                       coalesce(l.n, 0) AS new_links,
                       CASE WHEN again THEN 'revisited'
                            WHEN s.similarity > 0.5 THEN 'recycled'
                            WHEN coalesce(i.n, 0) + coalesce(l.n, 0) = 0 THEN 'nothing_new'
                            WHEN next_url IS NULL THEN 'no_next_link' END AS stop_reason
                FROM listing p LEFT JOIN i USING (crawl, page_idx) LEFT JOIN l USING (crawl, page_idx)
                LEFT JOIN scored s USING (crawl, page_idx))
            SELECT crawl, page_idx, new_items, new_links, stop_reason,
                   coalesce(stop_reason NOT IN ('revisited', 'recycled'), TRUE) AS gives_promotions,
                   coalesce(stop_reason NOT IN ('revisited', 'recycled'), TRUE) AND new_items + new_links > 0 AS gives_products
            FROM flagged f
            WHERE NOT EXISTS (SELECT 1 FROM flagged e WHERE e.crawl = f.crawl
                              AND e.page_no < f.page_no AND e.stop_reason IS NOT NULL)""",
    ),
    "crawl_run_rollup": f"""
        WITH units AS ({_UNITS.format(lineitem="lineitem")}),
        counts AS (SELECT run_id, count(*) FILTER (fetched) AS pages_fetched, count(error) AS errors,
                          bool_or(kind = 'discovery' AND error IS NOT NULL) AS lost FROM units GROUP BY 1)
        SELECT run_id, pages_fetched, errors,
               CASE WHEN lost OR (errors > 0 AND pages_fetched = 0) THEN 'failed'
                    WHEN errors > 0 THEN 'partial_failure' ELSE 'success' END AS status
        FROM counts""",
    "crawl_error_log": f"""
        WITH units AS ({_UNITS.format(lineitem="lineitem")})
        SELECT run_id, CASE kind WHEN 'discovery' THEN 'discovery: ' || error
                            WHEN 'homepage' THEN 'homepage ' || url || ': fetch failed'
                            ELSE kind || ' ' || url || ': fetch/extract failed' END AS line
        FROM units WHERE error IS NOT NULL""",
    "first_use_order": f"""
        WITH m AS ({_MESSAGES.format(conversations="conversations")}),
        f AS (SELECT conv_id, name, min(turn) AS turn FROM m WHERE kind = 'tool' GROUP BY ALL)
        SELECT conv_id, string_agg(name, ',' ORDER BY turn) AS tools FROM f GROUP BY conv_id""",
    "required_step_check": f"""
        WITH m AS ({_MESSAGES.format(conversations="conversations")}),
        r AS ({_ROUTES.format(conversations="conversations")})
        SELECT conv_id, route, CASE WHEN route = 'swot' THEN EXISTS (
                   SELECT 1 FROM m WHERE m.conv_id = r.conv_id AND kind = 'tool'
                     AND name = 'save_swot_analysis') END AS save_verified
        FROM r""",
    "text_blocks": "SELECT conv_id, turn, text FROM conversations",
}

"""Registered URL, link, sitemap and discovery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import urls as U
from ..operators import links as L
from ..session import spread
from ..sources.pages import with_tree
from . import page_queries as PQ
from .tables import table

# Page urls with further query parameters, some of them tracking ones.
_URLS = """
    SELECT page_id, url, CASE page_id % 5
               WHEN 0 THEN replace(url, '#top', '') || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END
                    || 'b=2&a=1&A=x%20y&UTM_Medium=mail&a=0&flag'
               WHEN 1 THEN replace(url, '.example.', '.Example.') || '//'
               ELSE url END AS raw
    FROM {pages}"""


def _urls(spark, sf_dir):
    return spark.sql(_URLS, pages=table(spark, sf_dir, "pages"))


def normalize_url(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", U.normalise(F.col("raw")).alias("url"))


def url_same_site(spark, sf_dir):
    bare = F.regexp_replace("url", r"^https?://(www\.)?", "https://WWW.")
    other = F.regexp_replace("url", r"^https?://[a-z]+\.", "https://")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        U.same_site(F.col("url"), bare).alias("same_as_www"),
        U.same_site(F.col("url"), other).alias("same_as_parent"),
    )


_PATHS = """
    SELECT p_partkey, 'https://x.example' || CASE p_partkey % 12
        WHEN 0 THEN '/products/' || p_name WHEN 1 THEN '/Item/' || p_type || '?sale/'
        WHEN 2 THEN '/shop/p/9' WHEN 3 THEN '/collections/sale-' || p_name
        WHEN 4 THEN '/categories/x' WHEN 5 THEN '/sale' WHEN 6 THEN '/about/deals/' || p_type
        WHEN 7 THEN '/promotions' WHEN 8 THEN '/sales/2' WHEN 9 THEN '/Catalog/' || p_name
        WHEN 10 THEN '/product' ELSE '/special-offers?x=/products/1' END AS url
    FROM {part}"""


def url_classify(spark, sf_dir):
    urls = spark.sql(_PATHS, part=table(spark, sf_dir, "part"))
    return urls.select("p_partkey", U.kind_by_path(F.col("url")).alias("kind"))


# One href of every form RFC 3986 knows, for every page.
_HREFS = """
    SELECT page_id, url, form, CASE form
        WHEN 0 THEN 'leaf' WHEN 1 THEN './leaf/' WHEN 2 THEN '../up/leaf' WHEN 3 THEN '/root/leaf'
        WHEN 4 THEN '//cdn.example/leaf' WHEN 5 THEN '?q=1' WHEN 6 THEN '#part'
        WHEN 7 THEN 'http://other.example/a/../b' WHEN 8 THEN 'a/./b/../c//d' WHEN 9 THEN 'mailto:x@y.example'
        ELSE '../../../..' END AS href
    FROM (SELECT page_id, url, explode(sequence(0, 10)) AS form FROM {pages})"""


def resolve_links(spark, sf_dir):
    hrefs = spark.sql(_HREFS, pages=table(spark, sf_dir, "pages"))
    return hrefs.select("page_id", "form", U.resolve(F.col("url"), F.col("href")).alias("link"))


def page_links(spark, sf_dir):
    """Every anchor of the given pages, resolved and normalised."""
    parsed = with_tree(spread(table(spark, sf_dir, "pages")))
    return L.links(parsed).select("page_id", "pos", "link")


_LISTING = """
    '<a href="/products/' || sku || '?utm_source=x&amp;v=1">a</a><a href="../products/' || sku || '">b</a>'
    || '<a href="/products/' || sku || '?v=1#reviews">again</a>'
    || '<a href="https://other.example/products/1">c</a>'
    || '<a href="/garden/' || CAST(page_id AS STRING) || '/deep/' || category || '/">d</a>'
    || '<a href="/garden/' || CAST(page_id AS STRING) || '">self</a><a href="/gardening/x">e</a>'
    || '<a href="/collections/all">f</a><a name="no-href">g</a><a href="' || replace(site, 'www.', '')
    || '/item/' || CAST(size AS STRING) || '">h</a>'"""


def product_links(spark, sf_dir):
    pages = PQ._rows(spark, sf_dir).select(
        "page_id", "url", F.col("site").alias("base_url"), F.expr(_LISTING).alias("html")
    )
    return L.product_links(with_tree(pages))


_ROBOTS = """
    SELECT n_nationkey AS site, 'User-agent: *' || chr(10) || 'SITEMAP:  https://s' || CAST(n_nationkey AS STRING)
        || '.example/a.xml ' || chr(13) || chr(10) || 'Disallow: /x' || chr(10)
        || CASE WHEN n_regionkey = 1 THEN 'sitemap:/sitemap.xml' || chr(10) ELSE '' END
        || ' Sitemap: indented' || chr(10) || 'Sitemap: https://s' || CAST(n_nationkey AS STRING)
        || '.example/sitemap.xml' AS text
    FROM {nation}"""


def _robots(spark, sf_dir):
    return spark.sql(_ROBOTS, nation=table(spark, sf_dir, "nation"))


def robots_sitemaps(spark, sf_dir):
    return L.robots_sitemaps(_robots(spark, sf_dir))


def sitemap_roots(spark, sf_dir):
    robots = _robots(spark, sf_dir)
    base = F.concat(F.lit("https://s"), F.col("site").cast("string"), F.lit(".example"))
    return L.sitemap_roots(robots, robots.select("site", base.alias("base_url")))


# Every second url set has its names under a prefix.
_SITEMAPS = """
    SELECT sitemap_url, CASE WHEN s_suppkey % 8 = 6
        THEN replace(regexp_replace(xml, '<(/?)([a-z])', '<$1sm:$2'), 'xmlns=', 'xmlns:sm=') ELSE xml END AS xml
    FROM (SELECT s_suppkey, 'https://s.example/' || CAST(s_suppkey AS STRING) || '.xml' AS sitemap_url,
        CASE s_suppkey % 4
        WHEN 0 THEN '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
             || '<sitemap><loc>' || s_name || '</loc></sitemap></sitemapindex>'
        WHEN 1 THEN '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>cut off'
        WHEN 2 THEN '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://s.example/'
             || CAST(s_suppkey AS STRING) || '?a=1&amp;b=2 </loc><priority>1</priority></url><url><lastmod>x</lastmod>'
             || '</url><url><loc>' || s_name || '</loc></url></urlset>'
        ELSE CASE WHEN s_suppkey % 8 = 3 THEN '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"></urlset>'
             ELSE '<urlset><url><loc>/outside-the-namespace</loc></url></urlset>' END END AS xml
    FROM {supplier})"""


def sitemap_locs(spark, sf_dir):
    documents = spark.sql(_SITEMAPS, supplier=table(spark, sf_dir, "supplier"))
    return L.sitemap_locs(documents)


# Sitemap tree: region index -> nation index -> supplier url set -> page urls,
# plus one edge back to the root of every region.
_LOCS = """
    SELECT 'r' || CAST(n_regionkey AS STRING) AS sitemap_url, TRUE AS is_index,
           CAST(n_nationkey AS INT) AS pos, 'n' || CAST(n_nationkey AS STRING) AS loc FROM {nation}
    UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), TRUE, 1000000, 'r' || CAST(n_regionkey AS STRING)
    FROM {nation}
    UNION ALL SELECT 'n' || CAST(s_nationkey AS STRING), TRUE, CAST(s_suppkey AS INT),
                     's' || CAST(s_suppkey AS STRING) FROM {supplier}
    UNION ALL SELECT 's' || CAST(l_suppkey AS STRING), FALSE, CAST(min(l_orderkey) AS INT),
                     '/products/' || CAST(l_partkey AS STRING)
    FROM {lineitem} GROUP BY l_suppkey, l_partkey"""


def _locs(spark, sf_dir):
    names = ("nation", "supplier", "lineitem")
    return spark.sql(_LOCS, **{n: table(spark, sf_dir, n) for n in names})


def _leaves(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    roots = region.select(
        F.col("r_regionkey").alias("site"),
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("sitemap_url"),
        F.lit(0).alias("pos"),
    )
    return L.expand_sitemaps(roots, _locs(spark, sf_dir))


def sitemap_expand(spark, sf_dir):
    leaves = _leaves(spark, sf_dir)
    return leaves.select("site", "url", "depth", F.array_join("trail", "/").alias("trail"))


# Crawl inputs per seller site: seeds, sitemap leaves and homepage links.
_SITES = """
    SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS site,
           'https://www.shop' || substr(p_brand, 7) || '.example' AS base_url FROM {part}"""
_SEEDS = """
    SELECT CAST(n_nationkey + 1 AS BIGINT) AS site, 0 AS pos, '/garden/' || lower(n_name) AS url FROM {nation}
    UNION ALL SELECT CAST(n_nationkey + 1 AS BIGINT), 1, '/collections/' || lower(n_name) FROM {nation}"""
_LEAVES = """
    SELECT l_suppkey % 25 + 1 AS site, l_orderkey AS pos, CASE l_linenumber
        WHEN 1 THEN '/products/' || CAST(l_partkey AS STRING)
        WHEN 2 THEN '/shop/' || CAST(l_partkey AS STRING)
        WHEN 3 THEN '/sale/' || CAST(l_partkey AS STRING)
        WHEN 4 THEN 'https://elsewhere.example/products/' || CAST(l_partkey AS STRING)
        ELSE '/pages/' || CAST(l_partkey AS STRING) END AS url
    FROM {lineitem}"""
_HOMEPAGE = """
    SELECT CAST(s_suppkey % 25 + 1 AS BIGINT) AS site, CAST(s_suppkey AS INT) AS pos,
           '/deals/' || CAST(s_nationkey AS STRING) AS url FROM {supplier}
    UNION ALL SELECT CAST(s_suppkey % 25 + 1 AS BIGINT), 1000000, '/products/1' FROM {supplier}"""


def _inputs(spark, sf_dir, sql):
    names = [n for n in ("part", "nation", "lineitem", "supplier") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def _discovered(spark, sf_dir):
    leaves = spread(_inputs(spark, sf_dir, _LEAVES)).select(
        "site", F.array(F.col("pos")).alias("trail"), "url"
    )
    return L.discover_urls(
        _inputs(spark, sf_dir, _SITES),
        _inputs(spark, sf_dir, _SEEDS),
        leaves,
        _inputs(spark, sf_dir, _HOMEPAGE),
    )


def discover_urls(spark, sf_dir):
    return _discovered(spark, sf_dir).select("site", "url", "origin", "kind", "url_no")


def crawl_frontier(spark, sf_dir):
    return L.crawl_frontier(_discovered(spark, sf_dir)).select("site", "url", "kind", "kind_no")


def url_kind_counts(spark, sf_dir):
    return L.kind_counts(_discovered(spark, sf_dir))


def product_url_frontier(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    category = part.select(
        F.expr("CAST(substr(p_brand, 7) AS BIGINT)").alias("site"),
        F.expr(
            "'https://www.shop' || substr(p_brand, 7) || '.example/products/' || CAST(p_partkey AS STRING)"
        ).alias("url"),
    )
    return L.product_url_frontier(category, _discovered(spark, sf_dir))


def url_classify_full(spark, sf_dir):
    """Unclassified page urls judged by page content."""
    pages = PQ._pages(spark, sf_dir)
    discovered = pages.select(
        "site", "url", F.col("page_id").alias("url_no"), U.kind_by_path(F.col("url")).alias("kind")
    )
    return L.reclassify_by_page(discovered, pages.select("url", "html")).select("site", "url", "kind")


def homepage_links(spark, sf_dir):
    """Links of the given pages, each page taken as a homepage."""
    parsed = with_tree(spread(table(spark, sf_dir, "pages")))
    return L.homepage_links(parsed.select(F.col("page_id").alias("site"), "tree"))


# Stored documents of every seller site: robots.txt, an index of one url set per size, a homepage, some pages.
_NAMESPACE = f'xmlns="{K.SITEMAP_NAMESPACE}"'
_SITE_ROBOTS = f"""
    SELECT site, 'Sitemap: ' || base_url || '/maps/index.xml' AS text FROM ({_SITES})"""
_SITE_PARTS = f"""
    SELECT site, base_url, p_size, p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/products/' WHEN 1 THEN '/sale/'
               ELSE '/pages/' END || CAST(p_partkey AS STRING) AS path
    FROM {{part}} JOIN ({_SITES}) ON site = CAST(substr(p_brand, 7) AS BIGINT)"""
_SITE_MAPS = f"""
    SELECT base_url || '/maps/' || p_size || '.xml' AS sitemap_url,
           '<urlset {_NAMESPACE}>' || array_join(transform(array_sort(collect_list(struct(p_partkey, path))),
               p -> '<url><loc>' || base_url || p.path || '</loc></url>'), '') || '</urlset>' AS xml
    FROM ({_SITE_PARTS}) GROUP BY base_url, p_size
    UNION ALL
    SELECT base_url || '/maps/index.xml',
           '<sitemapindex {_NAMESPACE}>' || array_join(transform(array_sort(collect_set(p_size)),
               s -> '<sitemap><loc>' || base_url || '/maps/' || s || '.xml</loc></sitemap>'), '') || '</sitemapindex>'
    FROM ({_SITE_PARTS}) GROUP BY base_url"""
_SITE_HOMES = f"""
    SELECT site, '<a href="/deals/' || CAST(site AS STRING)
        || '">d</a><a href="https://elsewhere.example/x">e</a><a href="about?utm_source=home">a</a>' AS html
    FROM ({_SITES})"""
_SITE_PAGES = f"""
    SELECT base_url || path AS url, '<script type="application/ld+json">{{{{"@type": "'
        || CASE p_partkey % 3 WHEN 1 THEN 'Product' ELSE 'CollectionPage' END || '"}}}}</script>' AS html
    FROM ({_SITE_PARTS}) WHERE p_partkey % 3 <> 0"""


def discover_site(spark, sf_dir):
    """Every seller site from robots.txt to urls classified by their pages."""
    inputs = (_SITES, _SEEDS, _SITE_ROBOTS, _SITE_MAPS, _SITE_HOMES, _SITE_PAGES)
    found = L.discover_site(*[_inputs(spark, sf_dir, sql) for sql in inputs])
    return found.select("site", "url", "origin", "kind", "url_no")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_url, url_same_site, url_classify, resolve_links, page_links, product_links,
        robots_sitemaps, sitemap_roots, sitemap_locs, sitemap_expand, discover_urls,
        crawl_frontier, url_kind_counts, product_url_frontier, url_classify_full, homepage_links,
        discover_site,
    )
}

_NAMES = {n: n for n in ("part", "nation", "lineitem", "supplier", "pages")}
_TRACKING = ", ".join(f"'{p}'" for p in K.TRACKING_PARAMS)


def _kind(path):
    tests = (("product", K.PRODUCT_PATH), ("promotional", K.PROMO_PATH), ("category", K.CATEGORY_PATH))
    # Java's U flag has no counterpart in DuckDB and does not matter for ASCII paths.
    cases = [f"WHEN regexp_matches({path}, '{p.replace('(?iU)', '(?i)')}') THEN '{kind}'" for kind, p in tests]
    return f"CASE {' '.join(cases)} ELSE 'unknown' END"


_CANONICAL = f"""
    CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END"""
_DISCOVERED = f"""
    sites AS ({_SITES.format(**_NAMES)}),
    added AS (
        SELECT site, url, 0 AS origin, pos, CASE WHEN {_kind("url")} = 'unknown' THEN 'category'
                                                 ELSE {_kind("url")} END AS kind
        FROM ({_SEEDS.format(**_NAMES)})
        UNION ALL SELECT site, url, 1, pos, {_kind("url")} FROM ({_LEAVES.format(**_NAMES)})
        UNION ALL SELECT site, url, 2, pos, {_kind("url")} FROM ({_HOMEPAGE.format(**_NAMES)})),
    firsts AS (
        SELECT a.site, s.base_url || a.url AS url, origin, pos, kind FROM added a JOIN sites s USING (site)
        WHERE a.url LIKE '/%'
        QUALIFY row_number() OVER (PARTITION BY a.site, a.url ORDER BY origin, pos, kind) = 1),
    discovered AS (
        SELECT site, url, origin, kind, row_number() OVER (PARTITION BY site ORDER BY origin, pos, url)
            AS url_no FROM firsts)"""

ORACLES = {
    "normalize_url": f"""
        WITH u AS ({_URLS.format(**_NAMES)}),
        p AS (SELECT page_id, regexp_extract(raw, '^(https?://[^/?#]*)', 1) AS origin,
                     regexp_extract(raw, '^https?://[^/?#]*([^?#]*)', 1) AS path,
                     regexp_extract(raw, '^[^?#]*\\?([^#]*)', 1) AS query FROM u),
        q AS (SELECT *, list_sort(list_transform(
                  list_filter(string_split(query, '&'),
                      lambda x: x <> '' AND NOT lower(split_part(x, '=', 1)) IN ({_TRACKING})),
                  lambda x: replace(CASE WHEN contains(x, '=') THEN x ELSE x || '=' END, '%20', '+'))) AS kept
              FROM p)
        SELECT page_id, origin || {_CANONICAL} AS url FROM q""",
    "url_same_site": r"""
        WITH o AS (SELECT page_id, url, regexp_replace(url, '^https?://[a-z]+\.', 'https://') AS other
                   FROM pages)
        SELECT page_id, TRUE AS same_as_www,
               regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\.', '')
                 = regexp_replace(regexp_extract(other, '^https?://([^/?#]*)', 1), '^www\.', '')
                   AS same_as_parent FROM o""",
    "url_classify": f"""
        WITH u AS ({_PATHS.format(**_NAMES)}),
        p AS (SELECT p_partkey, regexp_extract(url, '^https://[^/?#]*([^?#]*)', 1) AS path FROM u)
        SELECT p_partkey, {_kind("path")} AS kind FROM p""",
    "resolve_links": r"""
        WITH p AS (SELECT page_id, url, unnest(range(11)) AS form,
                          regexp_extract(url, '^(https?):', 1) AS scheme,
                          regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin,
                          regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
                          regexp_extract(url, '^([^#]*)', 1) AS whole FROM pages),
        d AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir,
                     regexp_replace(path, '[^/]*/?[^/]*$', '') AS up FROM p)
        SELECT page_id, form, CASE form WHEN 0 THEN origin || dir || 'leaf'
            WHEN 1 THEN origin || dir || 'leaf/'
            WHEN 2 THEN origin || regexp_replace(dir, '[^/]+/$', '') || 'up/leaf'
            WHEN 3 THEN origin || '/root/leaf' WHEN 4 THEN scheme || '://cdn.example/leaf'
            WHEN 5 THEN origin || path || '?q=1' WHEN 6 THEN whole
            WHEN 7 THEN 'http://other.example/a/../b' WHEN 8 THEN origin || dir || 'a/c/d'
            WHEN 9 THEN 'mailto:x@y.example' ELSE origin || '/' END AS link FROM d""",
    "page_links": r"""
        WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin,
                          regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
        u AS (SELECT page_id, origin, unnest(range(len(hrefs))) AS pos, unnest(hrefs) AS href FROM a)
        SELECT page_id, pos, origin || href AS link FROM u""",
    "product_links": f"""
        WITH b AS ({PQ._PLAIN})
        SELECT page_id, site || '/products/' || sku || '?v=1' AS link FROM b
        UNION ALL SELECT page_id, site || '/products/' || sku FROM b
        UNION ALL SELECT page_id, url || '/deep/' || category FROM b
        WHERE {_kind("'/deep/' || category")} = 'unknown'
        UNION ALL SELECT page_id, replace(site, 'www.', '') || '/item/' || size FROM b""",
    "robots_sitemaps": """
        SELECT n_nationkey AS site, 0 AS pos, 'https://s' || n_nationkey || '.example/a.xml' AS sitemap_url
        FROM nation
        UNION ALL SELECT n_nationkey, 1, '/sitemap.xml' FROM nation WHERE n_regionkey = 1
        UNION ALL SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END,
                         'https://s' || n_nationkey || '.example/sitemap.xml' FROM nation""",
    "sitemap_roots": """
        SELECT n_nationkey AS site, 0 AS pos, 'https://s' || n_nationkey || '.example/a.xml' AS sitemap_url
        FROM nation
        UNION ALL SELECT n_nationkey, 1, '/sitemap.xml' FROM nation WHERE n_regionkey = 1
        UNION ALL SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END,
                         'https://s' || n_nationkey || '.example/sitemap.xml' FROM nation""",
    "sitemap_locs": """
        SELECT 'https://s.example/' || s_suppkey || '.xml' AS sitemap_url, s_suppkey % 4 = 0 AS is_index,
               0 AS pos, CASE WHEN s_suppkey % 4 = 0 THEN s_name
                              ELSE 'https://s.example/' || s_suppkey || '?a=1&b=2' END AS loc
        FROM supplier WHERE s_suppkey % 4 IN (0, 2)
        UNION ALL SELECT 'https://s.example/' || s_suppkey || '.xml', FALSE, 2, s_name
        FROM supplier WHERE s_suppkey % 4 = 2""",
    "sitemap_expand": """
        WITH leaf AS (SELECT s.s_suppkey, n.n_nationkey, n.n_regionkey AS site, l_partkey,
                             min(l_orderkey) AS pos
                      FROM lineitem JOIN supplier s ON s_suppkey = l_suppkey
                      JOIN nation n ON n_nationkey = s_nationkey GROUP BY ALL)
        SELECT site, '/products/' || l_partkey AS url, 2 AS depth,
               array_to_string(min([0, n_nationkey, s_suppkey, pos]), '/') AS trail
        FROM leaf GROUP BY site, l_partkey""",
    "discover_urls": f"WITH {_DISCOVERED} SELECT site, url, origin, kind, url_no FROM discovered",
    "discover_site": f"""
        WITH sites AS ({_SITES.format(**_NAMES)}),
        added AS (
            SELECT site, 0 AS origin, pos AS a, 0 AS b, url AS path, NULL AS part FROM ({_SEEDS.format(**_NAMES)})
            UNION ALL SELECT site, 1, p_size, p_partkey, path, p_partkey FROM ({_SITE_PARTS.format(**_NAMES)})
            UNION ALL SELECT site, 2, 0, 0, '/deals/' || site, NULL FROM sites
            UNION ALL SELECT site, 2, 2, 0, '/about', NULL FROM sites),
        kinds AS (SELECT *, {_kind("path")} AS kind FROM added)
        SELECT site, base_url || path AS url, origin,
               CASE WHEN kind <> 'unknown' THEN kind WHEN origin = 0 THEN 'category'
                    WHEN part % 3 = 1 THEN 'product' WHEN part % 3 = 2 THEN 'category' ELSE 'unknown' END AS kind,
               row_number() OVER (PARTITION BY site ORDER BY origin, a, b) AS url_no
        FROM kinds JOIN sites USING (site)""",
    "crawl_frontier": f"""
        WITH {_DISCOVERED}
        SELECT site, url, kind, row_number() OVER (PARTITION BY site, kind ORDER BY url_no) AS kind_no
        FROM discovered""",
    "url_kind_counts": f"""
        WITH {_DISCOVERED}
        SELECT site, count(*) FILTER (kind = 'product') AS product,
               count(*) FILTER (kind = 'category') AS category,
               count(*) FILTER (kind = 'promotional') AS promotional,
               count(*) FILTER (kind = 'unknown') AS "unknown" FROM discovered GROUP BY site""",
    "product_url_frontier": f"""
        WITH {_DISCOVERED}
        SELECT site, url FROM discovered WHERE kind = 'product'
        UNION SELECT CAST(substr(p_brand, 7) AS BIGINT), 'https://www.shop' || substr(p_brand, 7)
                     || '.example/products/' || p_partkey FROM part""",
    "url_classify_full": f"""
        SELECT site, url, CASE WHEN shape = 1 AND size > 25 THEN 'category' WHEN shape <= 4 THEN 'product'
                   WHEN size % 2 = 0 THEN 'promotional' ELSE 'unknown' END AS kind FROM ({PQ._PLAIN})""",
    "homepage_links": """
        WITH a AS (SELECT page_id AS site, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs
                   FROM pages)
        SELECT site, unnest(range(len(hrefs))) AS pos, unnest(hrefs) AS url FROM a""",
}

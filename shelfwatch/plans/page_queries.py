"""Registered page queries.

Pages are built from the rows of ``part`` inside each query and read back, so
the expected values are plain columns. One page per part; six shapes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prices as P, text as X, tree as N
from ..operators import extraction as E
from .. import constants as K
from ..sources.pages import html_nodes as nodes_of, page_errors as errors_of, text_of_html, with_tree
from ..session import spread
from .tables import portable, table

_BASE = """
    SELECT p_partkey AS page_id, p_partkey % 6 AS shape, p_name AS name, p_brand AS brand,
           p_type AS category, p_size AS size, CAST(p_retailprice AS DECIMAL(12,2)) AS price,
           CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS cents,
           'https://www.shop' || substr(p_brand, 7) || '.example' AS site,
           'https://www.shop' || substr(p_brand, 7) || '.example/garden/'
               || CAST(p_partkey AS STRING) AS url,
           'SKU' || CAST(p_partkey AS STRING) AS sku,
           CASE WHEN p_size > 10 THEN 'InStock' ELSE 'OutOfStock' END AS stock
    FROM {part}"""

_OFFER = """'"offers":{"@type":"Offer","price":"$' || CAST(price AS STRING)
    || '","priceCurrency":"EUR","availability":"https://schema.org/' || stock || '"}'"""
_LD = """'<script type="application/ld+json">'"""
_SHAPES = f"""
    '<html><head><title>Shop</title>'
    || CASE WHEN shape = 4 THEN '<meta property="og:type" content="Product">' ELSE '' END
    || {_LD} || '{{not valid json</script></head><body>'
    || {_LD} || '{{"@type":"WebSite","name":"shop"}}</script>'
    || '<ul><li><a href="/stores">stores, sale days</a></li></ul>'
    || CASE shape
       WHEN 0 THEN {_LD} || '{{"@type":"Product","name":" ' || name || ' ","sku":"' || sku || '",'
            || {_OFFER} || '}}</script>'
       WHEN 1 THEN {_LD} || CASE WHEN size > 25 THEN '[{{"@type":"ItemList"}},' ELSE '[' END
            || '{{"@graph":[{{"@type":["Thing","Product"],"name":"' || name
            || '","sku":77,"mpn":"M1","category":"' || category || '","offers":['
            || '{{"price":' || CAST(price AS STRING) || '}},{{"price":1}}]}},'
            || '{{"@type":"Organization","name":"org"}}]}}]</script>'
       WHEN 2 THEN {_LD} || '{{"@type":"Product","name":"' || name || '","mpn":"' || sku
            || '","url":"../p/' || CAST(page_id AS STRING) || '#top","brand":{{"@type":"Brand","name":"'
            || brand || '"}},"image":["https://img.example/1.jpg","https://img.example/2.jpg"],'
            || '"offers":{{"@type":"AggregateOffer","lowPrice":' || CAST(price AS STRING)
            || ',"highPrice":99999}}}}</script>'
       WHEN 3 THEN '<div itemscope itemtype="http://schema.org/Product"><b><span itemprop="name">'
            || name || '</span></b><span itemprop="sku">' || sku
            || '</span><img itemprop="image" src="/i/' || CAST(page_id AS STRING) || '.png">'
            || '<div itemprop="offers" itemscope itemtype="http://schema.org/Offer">'
            || '<span itemprop="name">offer</span><span itemprop="price" content="'
            || CAST(price AS STRING) || '">about ten</span><meta itemprop="priceCurrency" content="EUR">'
            || '<link itemprop="availability" href="http://schema.org/' || stock || '"></div></div>'
       WHEN 4 THEN '<script type="application/json" id="productjson_' || sku || '">{{"title":"' || name
            || '","vendor":"' || brand || '","type":"' || category || '","variants":[{{"price":'
            || CAST(cents AS STRING) || ',"compare_at_price":'
            || CAST(cents + size % 2 * 1000 AS STRING) || ',"available":'
            || CASE WHEN size > 10 THEN 'true' ELSE 'false' END || ',"sku":"' || sku
            || '"}}],"featured_image":"https://img.example/f.jpg","description":"<div>About <i>'
            || name || '</i></div>"}}</script>'
       ELSE '<article class="tile Product"><h2>' || name || '</h2><p class="now-price">EUR '
            || CAST(price AS STRING) || '</p><a href="/products/' || CAST(page_id AS STRING)
            || '">more</a></article><li class="product"><div class="price">$1</div></li>' END
    || CASE WHEN shape = 5 AND size % 2 = 0
            THEN '<aside id="promo-strip">coupon for ' || name || '</aside>' ELSE '' END
    || CASE WHEN size > 30 THEN '<p>' || repeat('plain text about ' || brand || ', ', 12) || '</p>' ELSE '' END
    || CASE WHEN size % 7 = 0 THEN '<p>This shop {K.JS_REQUIRED_PHRASES[1]}.</p>' ELSE '' END
    || '<div class="imprint">free shipping terms</div></body></html>'"""


def _rows(spark, sf_dir):
    return spread(spark.sql(_BASE, part=table(spark, sf_dir, "part")))


def _pages(spark, sf_dir, html=_SHAPES):
    return _rows(spark, sf_dir).select("page_id", "site", "url", F.expr(html).alias("html"))


def _parsed(spark, sf_dir, html=_SHAPES):
    return with_tree(_pages(spark, sf_dir, html))


def _products(spark, sf_dir, source):
    rows = E.product_rows(_parsed(spark, sf_dir), source(F.col("tree"), F.col("url")))
    return portable(rows.drop("attributes", "promo_text"))


def jsonld_products(spark, sf_dir):
    return _products(spark, sf_dir, E.jsonld_products)


def microdata_products(spark, sf_dir):
    return _products(spark, sf_dir, E.microdata_products)


def embedded_json_products(spark, sf_dir):
    return _products(spark, sf_dir, E.embedded_products)


def generic_products(spark, sf_dir):
    return _products(spark, sf_dir, E.generic_products)


def extract_products(spark, sf_dir):
    return _products(spark, sf_dir, E.extract_products)


def jsonld_blocks(spark, sf_dir):
    from ..functions.jsonld import jsonld_blocks as blocks

    return _parsed(spark, sf_dir).select("page_id", F.size(blocks(F.col("tree"))).alias("blocks"))


def jsonld_nodes(spark, sf_dir):
    from ..functions.jsonld import node_types, string_at

    nodes = F.transform(
        E.jsonld_nodes(F.col("tree")),
        lambda v: F.struct(
            F.array_join(node_types(v), ",").alias("types"), string_at(v, "$.name").alias("name")
        ),
    )
    rows = _parsed(spark, sf_dir).select("page_id", F.posexplode(nodes).alias("pos", "n"))
    return rows.select("page_id", "pos", "n.*")


def microdata_props(spark, sf_dir):
    props = _parsed(spark, sf_dir).select(
        "page_id", F.inline(E.microdata_properties(F.col("tree")))
    )
    return props.drop("scope_id")


_CARDS = """
    '<ul>' || repeat('<li class="product-card"><h4>Item</h4><p class="price">$5.00</p></li>', size % 3)
    || repeat('<li class="product-card"><h4>Item</h4></li>', size % 5) || '</ul>'"""


def generic_trust(spark, sf_dir):
    products = E.generic_products(F.col("tree"), F.col("url"))
    counted = _parsed(spark, sf_dir, _CARDS).withColumn("products", products)
    return counted.select(
        "page_id", F.size("products").alias("found"), E.is_trusted(F.col("products")).alias("trusted")
    )


def page_signals(spark, sf_dir):
    return _parsed(spark, sf_dir).select("page_id", E.page_kind(F.col("tree")).alias("kind"))


def page_needs_render(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "page_id", E.needs_rendering(F.col("tree")).alias("needs_render")
    )


_NEXT = """
    '<body><a href="/first">1</a>' || CASE shape
    WHEN 0 THEN '<a rel="next" href="/wrong">x</a><link rel="next" href="?page=2">'
    WHEN 1 THEN '<a rel="nofollow next" href="/page/2#grid">more</a>'
    WHEN 2 THEN '<a href="">next</a><a href="two"> Next <b>Page</b></a><a href="two"> Next</a>'
    WHEN 3 THEN '<a aria-label="Go to next page" href="//cdn.example/p2">&gt;</a>'
    WHEN 4 THEN '<link rel="next" href=""><a href="/page/3">NEXT</a>'
    ELSE '<a href="/x">next one</a>' END || '</body>'"""


def next_link(spark, sf_dir):
    link = E.next_link(F.col("tree"), F.col("url")).alias("next_url")
    return _parsed(spark, sf_dir, _NEXT).select("page_id", link)


# One text for each kind of statement: percent, amount and code, signal only, none, percent after a long text.
_BANNER_TEXT = """CASE size % 5
    WHEN 0 THEN name || '   at ' || CAST(size AS STRING) || ' % OFF, ' || repeat(category || ' ', 12)
    WHEN 1 THEN 'coupon: Q' || CAST(size AS STRING) || 'Z gives $' || CAST(size AS STRING) || '.50 off ' || name
    WHEN 2 THEN brand || ' coupon booklet, ' || name
    WHEN 3 THEN 'Delivered by ' || brand
    ELSE 'Free Shipping ' || repeat(name || ' ', 40) || ' 10% off' END"""
_BANNERS = f"""
    '<div class="imprint">7% off coupon</div><a id="marquee7"><b>'
    || {_BANNER_TEXT} || '</b></a><section class="a topbar">' || {_BANNER_TEXT} || '</section>'"""


def campaign_detect(spark, sf_dir):
    return E.campaign_rows(_parsed(spark, sf_dir, _BANNERS))


def campaign_counts(spark, sf_dir):
    return E.campaign_counts(E.campaign_rows(_parsed(spark, sf_dir, _BANNERS)))


def html_nodes(spark, sf_dir):
    """Element counts of the given pages, checked against a count of start tags."""
    nodes = nodes_of(spread(table(spark, sf_dir, "pages")))
    return nodes.groupBy("page_id").agg(
        F.count_if(F.col("tag") == "a").alias("anchors"),
        F.count_if(F.col("tag") == "li").alias("items"),
        F.count_if(F.col("tag") == "article").alias("articles"),
    )


# A page for every conversation turn, with text in several elements and some that is not shown.
_TURN_PAGE = """
    '<html><head><title>' || role || '</title><style>p { margin: 0 }</style></head><body><p>'
    || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</p><script>let turn = 1</script><div> <b>'
    || CAST(turn AS STRING) || '</b><template>none</template></div></body></html>'"""


def page_text(spark, sf_dir):
    """Visible text of pages made of conversation turns."""
    turns = table(spark, sf_dir, "conversations")
    parsed = with_tree(turns.select("conv_id", "turn", F.expr(_TURN_PAGE).alias("html")))
    return parsed.select("conv_id", "turn", N.page_text(F.col("tree")).alias("text"))


# Some pages hold a marked section that the HTML parser gives up on.
_BROKEN = "CASE WHEN size % 9 = 4 THEN '<p>a</p><![' || lower(brand) || '[x]]>' ELSE '' END"


def page_errors(spark, sf_dir):
    """Pages that do not parse, next to pages that do."""
    parsed = _parsed(spark, sf_dir, f"{_SHAPES} || {_BROKEN}")
    broken = errors_of(parsed)
    return broken.select("page_id", "url", (F.length("error") > 0).alias("has_message"))


def strip_html(spark, sf_dir):
    """Conversation text marked up and stripped again."""
    html = F.expr(
        "'<div><!-- note --><p>' || replace(replace(text, '&', '&amp;'), '<', '&lt;')"
        " || '</p><script>var hidden = 1;</script><br/></div>'"
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text_of_html(html).alias("text")
    )


_PRICE_TEXT = """CASE p_partkey % 6 WHEN 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING)
    WHEN 1 THEN '$' || CAST(p_size AS STRING) || ',234.56' WHEN 2 THEN 'USD ' || CAST(p_size AS STRING) || '.'
    WHEN 3 THEN 'call for price' WHEN 4 THEN '-' || CAST(p_size AS STRING) || '.5 each, 2 for 9' END"""


def parse_price(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return portable(part.select("p_partkey", P.parse_price(F.expr(_PRICE_TEXT)).alias("price")))


_STOCK_TEXT = """CASE p_partkey % 6 WHEN 0 THEN 'https://schema.org/InStock'
    WHEN 1 THEN 'http://schema.org/OutOfStock' WHEN 2 THEN ' SoldOut ' WHEN 3 THEN 'schema.org/Discontinued'
    WHEN 4 THEN p_name END"""


def parse_availability(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", P.parse_availability(F.expr(_STOCK_TEXT)).alias("in_stock"))


def truncate_title(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", X.truncate_at_word(F.col("text")).alias("title"))


def discount_text(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.select("page_id", X.discount_text(F.expr(_BANNER_TEXT)).alias("discount_text"))


QUERIES = {
    f.__name__: f
    for f in (
        jsonld_blocks, jsonld_nodes, jsonld_products, microdata_props, microdata_products,
        embedded_json_products, generic_products, generic_trust, extract_products, page_signals,
        page_needs_render, next_link, campaign_detect, campaign_counts, html_nodes, page_text, page_errors,
        strip_html, parse_price, parse_availability, truncate_title, discount_text,
    )
}

_PLAIN = _BASE.format(part="part")


def _expected(shapes):
    return f"""
        WITH b AS ({_PLAIN})
        SELECT page_id, 0 AS pos,
               CASE WHEN shape IN (0, 2, 3, 4) THEN sku END AS sku, name,
               CAST(price AS DOUBLE) AS price,
               CASE WHEN shape = 4 AND size % 2 = 1 THEN CAST(price + 10 AS DOUBLE) END AS original_price,
               CASE WHEN shape IN (0, 3) THEN 'EUR' ELSE 'USD' END AS currency,
               CASE WHEN shape IN (0, 3, 4) THEN size > 10 ELSE TRUE END AS in_stock,
               CASE WHEN shape IN (1, 4) THEN category END AS category,
               CASE WHEN shape IN (2, 4) THEN brand END AS brand,
               CASE WHEN shape = 4 THEN 'About ' || name END AS description,
               CASE shape WHEN 2 THEN 'https://img.example/1.jpg' WHEN 4 THEN 'https://img.example/f.jpg'
                    WHEN 3 THEN site || '/i/' || page_id || '.png' END AS image_url,
               CASE shape WHEN 2 THEN site || '/p/' || page_id || '#top'
                    WHEN 5 THEN site || '/products/' || page_id ELSE url END AS url,
               CASE WHEN shape <= 2 THEN 'jsonld' WHEN shape = 3 THEN 'microdata'
                    WHEN shape = 4 THEN 'embedded_json' ELSE 'generic_html' END AS source
        FROM b WHERE shape IN ({shapes})"""


_DISCOUNT = """CASE size % 5 WHEN 0 THEN size || '% off'
    WHEN 1 THEN '$' || size || '.50 off; code Q' || size || 'Z'
    WHEN 4 THEN '10% off' ELSE '' END"""
_CUT = """CASE WHEN length(description) <= 80 THEN description
    ELSE regexp_extract(left(description, 80), '^(.*) [^ ]*$', 1, 's') || '…' END"""
_BANNER_ROWS = f"""
    b AS ({_PLAIN}),
    stated AS (SELECT *, trim(regexp_replace({_BANNER_TEXT}, '\\s+', ' ', 'g')) AS description,
                      {_DISCOUNT} AS discount_text
               FROM b WHERE size % 5 <> 3)"""

ORACLES = {
    "jsonld_blocks": f"SELECT page_id, CASE WHEN shape <= 2 THEN 2 ELSE 1 END AS blocks FROM ({_PLAIN})",
    "jsonld_nodes": f"""
        WITH b AS ({_PLAIN}),
        n AS (
            SELECT page_id, 0 AS rank, 'WebSite' AS types, 'shop' AS name FROM b
            UNION ALL SELECT page_id, 1, 'ItemList', NULL FROM b WHERE shape = 1 AND size > 25
            UNION ALL SELECT page_id, 2, CASE WHEN shape = 1 THEN 'Thing,Product' ELSE 'Product' END,
                             CASE WHEN shape = 0 THEN ' ' || name || ' ' ELSE name END
                      FROM b WHERE shape <= 2
            UNION ALL SELECT page_id, 3, 'Organization', 'org' FROM b WHERE shape = 1)
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY rank) - 1 AS pos, types, name
        FROM n""",
    "jsonld_products": _expected("0, 1, 2"),
    "microdata_products": _expected("3"),
    "embedded_json_products": _expected("4"),
    "generic_products": _expected("5"),
    "extract_products": _expected("0, 1, 2, 3, 4, 5"),
    "microdata_props": f"""
        WITH b AS ({_PLAIN} WHERE p_partkey % 6 = 3)
        SELECT page_id, 'name' AS property, name AS value FROM b
        UNION ALL SELECT page_id, 'sku', sku FROM b
        UNION ALL SELECT page_id, 'image', '/i/' || page_id || '.png' FROM b
        UNION ALL SELECT page_id, 'offers', 'offerabout ten' FROM b""",
    "generic_trust": f"""
        SELECT page_id, size % 3 + size % 5 AS found,
               size % 3 >= greatest(1, (size % 3 + size % 5) // 2) AND size % 3 + size % 5 > 0 AS trusted
        FROM ({_PLAIN})""",
    "page_signals": f"""
        SELECT page_id, CASE WHEN shape = 1 AND size > 25 THEN 'category' WHEN shape <= 4 THEN 'product'
                             WHEN size % 2 = 0 THEN 'promotional' ELSE 'unknown' END AS kind
        FROM ({_PLAIN})""",
    "page_needs_render": f"""
        SELECT page_id, shape > 2 AND (size <= 30 OR size % 7 = 0) AS needs_render FROM ({_PLAIN})""",
    "next_link": f"""
        SELECT page_id, CASE shape WHEN 0 THEN url || '?page=2' WHEN 1 THEN site || '/page/2#grid'
                        WHEN 2 THEN site || '/garden/two' WHEN 3 THEN 'https://cdn.example/p2'
                        WHEN 4 THEN site || '/page/3' END AS next_url
        FROM ({_PLAIN})""",
    "campaign_detect": f"""
        WITH {_BANNER_ROWS}
        SELECT page_id, 0 AS pos, {_CUT} AS title, description, discount_text, url AS source_url,
               discount_text <> '' AS is_confident FROM stated""",
    "campaign_counts": f"""
        WITH {_BANNER_ROWS}
        SELECT page_id, count(*) FILTER (discount_text <> '') AS confident,
               count(*) FILTER (discount_text = '') AS ambiguous FROM stated GROUP BY page_id""",
    "html_nodes": """
        SELECT page_id, len(regexp_extract_all(html, '<a[ >]')) AS anchors,
               len(regexp_extract_all(html, '<li[ >]')) AS items,
               len(regexp_extract_all(html, '<article[ >]')) AS articles FROM pages""",
    "page_text": r"""
        SELECT conv_id, turn, array_to_string(list_filter(
            [role, regexp_replace(text, '^\s+|\s+$', '', 'g'), CAST(turn AS VARCHAR)], lambda x: x <> ''), ' ') AS text
        FROM conversations""",
    "page_errors": f"SELECT page_id, url, TRUE AS has_message FROM ({_PLAIN}) WHERE size % 9 = 4",
    "strip_html": r"SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations",
    "parse_price": f"""
        SELECT p_partkey, CAST(nullif(regexp_extract(replace({_PRICE_TEXT}, ',', ''), '[0-9]+\\.?[0-9]*'), '')
                               AS DOUBLE) AS price FROM part""",
    "parse_availability": "SELECT p_partkey, p_partkey % 6 NOT IN (1, 2, 3) AS in_stock FROM part",
    "truncate_title": r"""
        WITH t AS (SELECT doc_id, text, left(text, 80) AS head FROM documents)
        SELECT doc_id, CASE WHEN length(text) <= 80 THEN text
            WHEN regexp_matches(head, '^.+ ', 's') THEN regexp_extract(head, '^(.+) [^ ]*$', 1, 's') || '…'
            ELSE head || '…' END AS title FROM t""",
    "discount_text": f"SELECT page_id, {_DISCOUNT} AS discount_text FROM ({_PLAIN})",
}

"""Products, promotions, links and signals read off stored pages.

Every function takes columns of one page row (``tree`` and ``url``) and gives a
column, so extraction is a map over pages: no joins and no shuffles. Rows per
product, banner or link come from exploding the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.binding import let
from ..functions import jsonld as J, prices as P, text as X, tree as N, urls as U
from ..sources.pages import page_errors, text_of_html, with_tree

# Extension point: seller slug -> rule giving an array of products for a page,
# used when a page has no structured data. Empty until a rule has been checked
# against the real site.
SiteRule = Callable[[Column, Column], Column]
SITE_RULES: dict[str, SiteRule] = {}


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _product(source: str, **fields: Column) -> Column:
    """A product record with the given fields; the rest take their defaults."""
    defaults = {
        "sku": _null("string"),
        "name": _null("string"),
        "price": _null(P.PRICE_TYPE),
        "original_price": _null(P.PRICE_TYPE),
        "currency": F.lit(K.DEFAULT_CURRENCY),
        "in_stock": F.lit(True),
        "promo_text": F.lit(""),
        "category": _null("string"),
        "brand": _null("string"),
        "description": _null("string"),
        "image_url": _null("string"),
        "url": _null("string"),
        "attributes": _null("map<string,string>"),
        "source": F.lit(source),
    }
    return F.struct(*[F.coalesce(fields.get(k, d), d).alias(k) for k, d in defaults.items()])


# --- JSON-LD -----------------------------------------------------------------


def _first_or_self(value: Column) -> Column:
    """The first member of a list (null when empty); any other value unchanged."""
    members = J.list_at(value, "$")
    return F.when(members.isNotNull(), N.first(members)).otherwise(value)


def _image(value: Column) -> Column:
    """A string, the first of a list, or an object's url."""
    return let(
        _first_or_self(value), lambda v: F.coalesce(J.string_at(v, "$"), J.string_at(v, "$.url"))
    )


def _brand(value: Column) -> Column:
    return F.coalesce(
        X.blank_to_null(J.string_at(value, "$.brand")), J.string_at(value, "$.brand.name")
    )


def _jsonld_product(node: Column, page_url: Column) -> Column:
    """``node`` with its first offer as a product record."""
    offer = let(J.at(node, "$.offers"), _first_or_self)
    return let(offer, lambda o: _jsonld_record(node, o, page_url))


def _jsonld_record(node: Column, offer: Column, page_url: Column) -> Column:
    price = F.coalesce(
        J.number_or_text_price(J.at(offer, "$.price")),
        J.number_or_text_price(J.at(offer, "$.lowPrice")),
    )
    sku = F.when(J.is_truthy(J.at(node, "$.sku")), J.string_at(node, "$.sku")).otherwise(
        J.string_at(node, "$.mpn")
    )
    own_url = F.coalesce(J.string_at(node, "$.url"), page_url)
    return _product(
        "jsonld",
        sku=sku,
        name=X.strip(J.string_at(node, "$.name")),
        price=price,
        currency=X.blank_to_null(J.string_at(offer, "$.priceCurrency")),
        in_stock=P.parse_availability(J.string_at(offer, "$.availability")),
        category=J.string_at(node, "$.category"),
        brand=_brand(node),
        description=J.string_at(node, "$.description"),
        image_url=let(J.at(node, "$.image"), _image),
        url=U.resolve_with_fragment(page_url, own_url),
    )


def jsonld_nodes(tree: Column) -> Column:
    """All JSON-LD objects of a page in document order."""
    return J.flatten_nodes(J.jsonld_blocks(tree))


def jsonld_products(tree: Column, page_url: Column) -> Column:
    """Products among the JSON-LD objects that have a name."""
    named = F.filter(
        jsonld_nodes(tree),
        lambda v: F.array_contains(J.node_types(v), "Product")
        & (X.strip(F.coalesce(J.string_at(v, "$.name"), F.lit(""))) != ""),
    )
    return F.transform(named, lambda v: _jsonld_product(v, page_url))


# --- microdata ---------------------------------------------------------------


def _own_properties(tree: Column, scope: Column) -> Column:
    """itemprop elements of ``scope`` that no nested itemscope owns."""
    return F.filter(
        tree["nodes"],
        lambda n: N.has_attr(n, "itemprop")
        & N.inside(n, scope)
        & (F.coalesce(n["scope"], F.lit(-1)) <= scope["id"]),
    )


def _property(properties: Column, name: str) -> Column:
    return N.first(F.filter(properties, lambda n: N.attr(n, "itemprop") == name))


def _value(tree: Column, node: Column) -> Column:
    """content, else href of a link, else src of an image, else the text."""

    def read(n: Column) -> Column:
        return (
            F.when(N.has_attr(n, "content"), N.attr(n, "content"))
            .when(n["tag"].isin("a", "link") & N.has_attr(n, "href"), N.attr(n, "href"))
            .when((n["tag"] == "img") & N.has_attr(n, "src"), N.attr(n, "src"))
            .otherwise(X.blank_to_null(N.subtree_text(tree, n, "")))
        )

    return let(node, read)


def microdata_scopes(tree: Column) -> Column:
    return F.filter(
        tree["nodes"],
        lambda n: F.coalesce(N.attr(n, "itemtype").rlike(K.PRODUCT_ITEMTYPE), F.lit(False)),
    )


def microdata_properties(tree: Column) -> Column:
    """(scope id, property, value) of every product scope on the page."""

    def of_scope(scope: Column) -> Column:
        return F.transform(
            _own_properties(tree, scope),
            lambda n: F.struct(
                scope["id"].alias("scope_id"),
                N.attr(n, "itemprop").alias("property"),
                _value(tree, n).alias("value"),
            ),
        )

    return F.flatten(F.transform(microdata_scopes(tree), of_scope))


def microdata_products(tree: Column, page_url: Column) -> Column:
    """Products expressed as schema.org microdata, with their first nested offer."""

    def of_scope(scope: Column) -> Column:
        return let(_own_properties(tree, scope), of_properties)

    def of_properties(own: Column) -> Column:
        offered = let(_property(own, "offers"), lambda offer: _own_properties(tree, offer))
        return let(offered, lambda o: record(own, o))

    def record(own: Column, offered: Column) -> Column:
        def value(properties: Column, name: str) -> Column:
            return _value(tree, _property(properties, name))

        stated = let(
            _property(offered, "availability"),
            lambda n: F.coalesce(X.blank_to_null(N.attr(n, "href")), _value(tree, n)),
        )
        image = X.blank_to_null(value(own, "image"))
        return _product(
            "microdata",
            sku=value(own, "sku"),
            name=value(own, "name"),
            price=P.parse_price(value(offered, "price")),
            currency=X.blank_to_null(value(offered, "priceCurrency")),
            in_stock=P.parse_availability(stated),
            category=value(own, "category"),
            brand=value(own, "brand"),
            description=value(own, "description"),
            image_url=U.resolve_with_fragment(page_url, image),
            url=page_url,
        )

    products = F.transform(microdata_scopes(tree), of_scope)
    named = F.filter(products, lambda p: F.coalesce(p["name"] != "", F.lit(False)))
    return F.transform(named, lambda p: p.withField("name", X.strip(p["name"])))


# --- embedded product JSON ---------------------------------------------------


def embedded_products(tree: Column, page_url: Column) -> Column:
    """Products from storefront JSON scripts; integer prices are cents.

    ``description`` still holds markup here; ``product_rows`` strips it.
    """
    scripts = F.filter(
        J.script_blocks(tree, "application/json"),
        lambda n: F.lower(F.coalesce(N.attr(n, "id"), F.lit(""))).startswith(
            K.EMBEDDED_PRODUCT_ID_PREFIX
        ),
    )
    parsed = F.transform(scripts, lambda n: F.try_parse_json(n["raw"]))
    titled = F.filter(
        parsed,
        lambda v: J.is_object(v)
        & (X.strip(F.coalesce(J.string_at(v, "$.title"), F.lit(""))) != ""),
    )

    def record(v: Column) -> Column:
        def variant_or_product(field: str) -> Column:
            return F.coalesce(J.at(v, f"$.variants[0].{field}"), J.at(v, f"$.{field}"))

        price = J.cents_or_text_price(variant_or_product("price"))
        original = J.cents_or_text_price(variant_or_product("compare_at_price"))
        variant_sku = J.at(v, "$.variants[0].sku")
        available = J.at(v, "$.variants[0].available")
        sku = F.when(J.is_truthy(variant_sku), J.string_at(variant_sku, "$")).otherwise(
            J.string_at(v, "$.sku")
        )
        return _product(
            "embedded_json",
            sku=sku,
            name=X.strip(J.string_at(v, "$.title")),
            price=price,
            original_price=P.markdown_price(original, price),
            in_stock=available.isNull() | J.is_truthy(available),
            category=J.string_at(v, "$.type"),
            brand=J.string_at(v, "$.vendor"),
            description=J.string_at(v, "$.description"),
            image_url=F.coalesce(
                J.string_at(v, "$.featured_image"), J.string_at(v, "$.images[0]")
            ),
            url=page_url,
        )

    return F.transform(titled, record)


# --- generic product cards ---------------------------------------------------


def generic_products(tree: Column, page_url: Column) -> Column:
    """Product-card shaped elements: heading, price-looking element and link."""

    def classed(tags: list[str], pattern: str):
        return lambda n: n["tag"].isin(tags) & F.coalesce(
            N.attr(n, "class").rlike(pattern), F.lit(False)
        )

    cards = N.nodes_where(tree, classed(K.CARD_TAGS, K.CARD_CLASS))
    parts = F.struct(
        N.nodes_where(tree, lambda n: n["tag"].isin(K.CARD_HEADING_TAGS)).alias("headings"),
        N.nodes_where(tree, classed(K.CARD_PRICE_TAGS, K.CARD_PRICE_CLASS)).alias("prices"),
        N.nodes_where(tree, lambda n: (n["tag"] == "a") & N.has_attr(n, "href")).alias("links"),
    )

    def read(found: Column) -> Column:
        def record(card: Column) -> Column:
            def first_inside(kind: str) -> Column:
                return N.first(F.filter(found[kind], lambda n: N.inside(n, card)))

            def first_text(kind: str) -> Column:
                return let(first_inside(kind), lambda n: N.subtree_text(tree, n, ""))

            href = N.attr(first_inside("links"), "href")
            return _product(
                "generic_html",
                name=first_text("headings"),
                price=P.parse_price(first_text("prices")),
                url=F.coalesce(U.resolve_with_fragment(page_url, href), page_url),
            )

        return F.transform(cards, record)

    return F.filter(
        let(parts, read), lambda p: F.coalesce(p["name"] != "", F.lit(False))
    )


def is_trusted(products: Column) -> Column:
    """At least one product and prices on half of them (rounded down, one at least)."""
    priced = F.size(F.filter(products, lambda p: p["price"].isNotNull()))
    half = F.floor(F.size(products) / 2)
    return (F.size(products) > 0) & (priced >= F.greatest(F.lit(1), half))


# --- all sources in order ----------------------------------------------------


def _site_products(tree: Column, page_url: Column, slug: Column | None) -> Column | None:
    rule_column = None
    for known, rule in SITE_RULES.items():
        if slug is None:
            break
        hit = slug == known
        products = rule(tree, page_url)
        rule_column = F.when(hit, products) if rule_column is None else rule_column.when(hit, products)
    return rule_column


def extract_products(tree: Column, page_url: Column, slug: Column | None = None) -> Column:
    """Products of the first source that has any; null when none is trusted.

    Order: JSON-LD, microdata, embedded JSON, site rule, generic cards.
    """
    sources = [
        jsonld_products(tree, page_url),
        microdata_products(tree, page_url),
        embedded_products(tree, page_url),
    ]
    site = _site_products(tree, page_url, slug)
    if site is not None:
        sources.append(site)
    generic = F.filter(F.array(generic_products(tree, page_url)), is_trusted)
    return F.coalesce(N.first_filled(*sources), F.get(generic, F.lit(0)))


def product_rows(
    pages: DataFrame, products: Column, key: str = "page_id", *kept: str
) -> DataFrame:
    """One row per product; markup in embedded descriptions becomes text."""
    rows = pages.select(key, *kept, F.posexplode(products).alias("pos", "p"))
    rows = rows.select(key, *kept, "pos", "p.*")
    is_markup = F.col("source") == "embedded_json"
    plain = text_of_html(F.when(is_markup, F.col("description")))
    return rows.withColumn(
        "description", F.when(is_markup, plain).otherwise(F.col("description"))
    )


def extract_pages(
    pages: DataFrame, key: str = "page_id", slug: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(product rows, unresolved pages, pages that do not parse) of a table with ``url`` and ``html``."""
    parsed = with_tree(pages)
    found = extract_products(F.col("tree"), F.col("url"), F.col(slug) if slug else None)
    read = parsed.withColumn("products", found)
    readable = F.col("tree.error").isNull()
    unresolved = read.where(F.col("products").isNull() & readable).select(key, "url")
    return product_rows(read, F.col("products"), key), unresolved, page_errors(parsed, key)


# --- promotions --------------------------------------------------------------


def banner_texts(tree: Column) -> Column:
    """Distinct banner texts with discount language, in document order, whole."""

    def hinted(n: Column) -> Column:
        return n["tag"].isin(K.BANNER_TAGS) & (
            F.coalesce(N.attr(n, "class").rlike(K.BANNER_HINT), F.lit(False))
            | F.coalesce(N.attr(n, "id").rlike(K.BANNER_HINT), F.lit(False))
        )

    def clean(n: Column) -> Column:
        return X.collapse_spaces(N.subtree_text(tree, n, " "))

    texts = F.array_distinct(F.transform(N.nodes_where(tree, hinted), clean))
    return F.filter(texts, lambda t: (t != "") & t.rlike(K.DISCOUNT_SIGNAL))


def campaign_rows(
    pages: DataFrame, key: str = "page_id", *kept: str, texts: Column | None = None
) -> DataFrame:
    """One row per banner. ``is_confident`` banners state their discount; the
    others are promotional but need wording by hand or by a model."""
    found = banner_texts(F.col("tree")) if texts is None else texts
    banners = pages.select(key, *kept, "url", F.posexplode(found).alias("pos", "text"))
    discount = X.discount_text(F.col("text"))
    return banners.select(
        key,
        *kept,
        "pos",
        X.truncate_at_word(F.col("text")).alias("title"),
        F.col("text").alias("description"),
        discount.alias("discount_text"),
        F.col("url").alias("source_url"),
        (discount != "").alias("is_confident"),
    )


def campaign_counts(banners: DataFrame, key: str = "page_id") -> DataFrame:
    return banners.groupBy(key).agg(
        F.count_if("is_confident").alias("confident"),
        F.count_if(~F.col("is_confident")).alias("ambiguous"),
    )


# --- page signals and links --------------------------------------------------


def page_kind(tree: Column) -> Column:
    """product, category, promotional or unknown, judged by the page's content."""
    kinds = F.transform(
        F.transform(jsonld_nodes(tree), J.node_types),
        lambda types: F.when(F.array_contains(types, "Product"), "product").when(
            F.array_contains(types, "CollectionPage") | F.array_contains(types, "ItemList"),
            "category",
        ),
    )
    og_type = N.first(
        N.nodes_where(
            tree, lambda n: (n["tag"] == "meta") & (N.attr(n, "property") == "og:type")
        )
    )
    return F.coalesce(
        N.first(F.array_compact(kinds)),
        F.when(F.size(microdata_scopes(tree)) > 0, "product"),
        F.when(F.lower(N.attr(og_type, "content")) == "product", "product"),
        F.when(F.size(banner_texts(tree)) > 0, "promotional"),
        F.lit("unknown"),
    )


def needs_rendering(tree: Column) -> Column:
    """No product data and too little text, or a note that scripts are required."""
    structured = F.exists(
        jsonld_nodes(tree),
        lambda v: F.arrays_overlap(
            J.node_types(v), F.array(*[F.lit(t) for t in ("Product", "Offer", "AggregateOffer")])
        ),
    )
    text = N.page_text(tree)
    asks = F.lit(False)
    for phrase in K.JS_REQUIRED_PHRASES:
        asks = asks | F.lower(text).contains(phrase)
    return ~structured & ((F.length(text) < K.MIN_USABLE_TEXT) | asks)


def next_link(tree: Column, page_url: Column) -> Column:
    """The declared next page: link rel=next, else a rel=next, else a 'next' anchor."""

    def rel_next(tag: str) -> Column:
        return N.first(
            N.nodes_where(
                tree,
                lambda n: (n["tag"] == tag) & F.array_contains(N.attr_tokens(n, "rel"), "next"),
            )
        )

    def says_next(n: Column) -> Column:
        label = F.lower(N.subtree_text(tree, n, ""))
        aria = F.lower(F.coalesce(N.attr(n, "aria-label"), F.lit("")))
        hit = label.isin("next", "next page") | aria.contains("next page") | (aria == "next")
        return (n["tag"] == "a") & hit & (F.coalesce(N.attr(n, "href"), F.lit("")) != "")

    declared = F.coalesce(rel_next("link"), rel_next("a"))
    by_label = N.first(N.nodes_where(tree, says_next))
    href = F.coalesce(X.blank_to_null(N.attr(declared, "href")), N.attr(by_label, "href"))
    return U.resolve_with_fragment(page_url, href)


def anchor_hrefs(tree: Column) -> Column:
    """href of every anchor that has one, in document order."""
    anchors = N.nodes_where(tree, lambda n: (n["tag"] == "a") & N.has_attr(n, "href"))
    return F.transform(anchors, lambda n: N.attr(n, "href"))

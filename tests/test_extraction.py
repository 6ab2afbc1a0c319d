"""Extraction from made-up pages against rules written out in plain Python.

Pages are drawn at random from parts, all pages of a test go through Spark at
once, and what is expected follows from the parts that were drawn.
"""

import json
import random
import re
from decimal import Decimal
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwatch import constants as K
from shelfwatch.functions import tree as N
from shelfwatch.operators import extraction as E, links as L
from shelfwatch.sources import pages as sources
from shelfwatch.sources.pages import html_nodes, page_errors, with_tree

SITE = "https://plants.example"
URL = SITE + "/aisle/7/"
PAGE = "page_id int, url string, base_url string, html string"


def parsed(spark, pages):
    return with_tree(spark.createDataFrame([(i, URL, SITE, p) for i, p in enumerate(pages)], PAGE).repartition(4))


def values(spark, pages, column):
    rows = parsed(spark, pages).select("page_id", column(F.col("tree"), F.col("url")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.page_id)]


def ld(thing):
    text = thing if isinstance(thing, str) else json.dumps(thing)
    return f'<script type="application/ld+json">{text}</script>'


def python_pattern(java):
    flags = re.match(r"\(\?(\w+)\)", java)
    return re.compile(java[flags.end() :] if flags else java, re.I if flags and "i" in flags[1] else 0)


# --- JSON-LD -----------------------------------------------------------------------


def wrapped(rng, thing, depth):
    for _ in range(depth):
        thing = rng.choice([[thing], {"@graph": [thing]}, [[], thing], {"@type": "WebPage", "@graph": [thing, 5]}])
    return thing


def test_products_under_any_wrapping(spark):
    rng = random.Random(21)
    depths = [0, 1, 2, 3, 5, 9, 70, 120]
    pages = [ld(wrapped(rng, {"@type": "Product", "name": f"p{d}"}, d)) for d in depths]
    got = values(spark, pages, E.jsonld_products)
    assert [[p["name"] for p in page] for page in got] == [[f"p{d}"] for d in depths]


def test_blocks_that_are_no_product(spark):
    things = ["{", "", "[]", "null", '"Product"', {"@type": "Product"}, {"@type": "Product", "name": " \t"},
              {"@type": "Product", "name": 3}, {"@type": "product", "name": "x"}, {"@graph": {"@type": "Product", "name": "x"}}]
    pages = [ld(t) for t in things] + ['<script type="text/plain">{"@type":"Product","name":"x"}</script>']
    assert values(spark, pages, E.jsonld_products) == [[]] * len(pages)


# What a JSON value says of itself, by its type: a string is false only when empty.
TRUTH = [("0", True), ("false", True), ("", False), ("x", True), (0, False), (7, True), (0.0, False), (True, True),
         (False, False), (None, False), ([], False), ({}, False), ([0], True), ({"a": 0}, True)]


def test_sku_falls_back_on_mpn_by_json_truth(spark):
    pages = [ld({"@type": "Product", "name": "n", "sku": sku, "mpn": "M"}) for sku, _ in TRUTH]
    want = [sku if truth and isinstance(sku, str) else None if truth else "M" for sku, truth in TRUTH]
    assert [p[0]["sku"] for p in values(spark, pages, E.jsonld_products)] == want


def test_offer_fields(spark):
    offers = [
        ({"price": "2,000.50"}, "2000.5", "USD", True), ({"price": 3, "priceCurrency": "SEK"}, "3", "SEK", True),
        ([{"lowPrice": "from 4"}, {"price": 9}], "4", "USD", True), ([], None, "USD", True), ("free", None, "USD", True),
        ({"price": False, "lowPrice": 5.25}, "5.25", "USD", True), (None, None, "USD", True),
        ({"availability": "SoldOut", "priceCurrency": ""}, None, "USD", False),
        ({"price": None, "availability": 1}, None, "USD", True),
    ]
    got = values(spark, [ld({"@type": ["Thing", "Product"], "name": "n", "offers": o}) for o, *_ in offers], E.jsonld_products)
    for (page,), (_, price, currency, stock) in zip(got, offers):
        assert (page.price, page.currency, page.in_stock) == (None if price is None else Decimal(price), currency, stock)


def test_brand_image_and_address(spark):
    cases = [
        ({"brand": "Moss & Co", "image": "a.png", "url": "x#y"}, "Moss & Co", "a.png", URL + "x#y"),
        ({"brand": {"name": "Mossy"}, "image": [{"url": "b.png"}, "c.png"], "url": "/z"}, "Mossy", "b.png", SITE + "/z"),
        ({"brand": "", "image": []}, None, None, URL), ({"brand": 4, "image": 4, "url": 4}, None, None, URL),
    ]
    got = values(spark, [ld({"@type": "Product", "name": "n", **c}) for c, *_ in cases], E.jsonld_products)
    assert [(p.brand, p.image_url, p.url) for (p,) in got] == [c[1:] for c in cases]


# --- microdata -----------------------------------------------------------------------


def test_microdata_properties_belong_to_the_nearest_scope(spark):
    rng, pages, want = random.Random(22), [], []
    for _ in range(40):
        props = {p: f"{p}{rng.randrange(99)}" for p in rng.sample(["name", "sku", "brand", "category"], rng.randrange(1, 5))}
        inner = {p: f"inner{rng.randrange(99)}" for p in rng.sample(["name", "sku", "price"], rng.randrange(3))}
        price = f"{rng.randrange(1, 99)}.50" if rng.random() < 0.7 else None
        parts = [f'<{rng.choice(["b", "h2", "td"])} itemprop="{p}">{v}</i>' for p, v in props.items()]
        parts.append('<u itemscope itemtype="x/Rating">' + "".join(f'<s itemprop="{p}">{v}</s>' for p, v in inner.items()) + "</u>")
        if price:
            parts.append(f'<p itemprop="offers" itemscope><meta itemprop="price" content="{price}"></p>')
        rng.shuffle(parts)
        body = "".join(x.replace("</i>", "</" + re.match(r"<(\w+)", x)[1] + ">") for x in parts)
        pages.append(f'<main itemscope itemtype="https://schema.org/Product">{body}</main>')
        want.append([] if "name" not in props else [(props["name"], props.get("sku"), props.get("brand"), price and Decimal(price))])
    got = values(spark, pages, E.microdata_products)
    assert [[(p["name"], p.sku, p.brand, p.price) for p in page] for page in got] == want


def test_where_a_property_keeps_its_value(spark):
    forms = {'<meta itemprop="brand" content="C">': "C", '<a itemprop="brand" href="/h">t</a>': "/h",
             '<img itemprop="brand" src="s.png">': "s.png", '<a itemprop="brand">t</a>': "t",
             '<i itemprop="brand" href="/h"> t <b>u</b></i>': "tu", '<i itemprop="brand"> </i>': None}
    scope = '<div itemscope itemtype="http://schema.org/Product"><q itemprop="name">n</q>{}</div>'
    got = values(spark, [scope.format(f) for f in forms], E.microdata_products)
    assert [p.brand for (p,) in got] == list(forms.values())


# --- embedded product JSON -----------------------------------------------------------


def expected_embedded(thing):
    first = (thing.get("variants") or [{}])[0]

    def money(field):
        value = first.get(field, thing.get(field))
        if isinstance(value, int):
            return Decimal(value) / 100
        found = re.search(K.PRICE_NUMBER, (value or "").replace(",", ""))
        return Decimal(found[0]) if found else None

    price, was = money("price"), money("compare_at_price")
    marked_down = was is not None and (price is None or was > price)
    return (thing["title"].strip(), price, was if marked_down else None,
            first.get("sku") or thing.get("sku"), first.get("available", True), thing.get("vendor"))


def test_embedded_products(spark):
    rng, things = random.Random(23), []
    for k in range(60):
        thing = {"title": rng.choice([f"plant {k}", f" plant {k} "])}
        for field, choices in (("vendor", ["V", "W"]), ("sku", ["own"]), ("price", [350, "3.5"]), ("compare_at_price", [900, 100])):
            if rng.random() < 0.6:
                thing[field] = rng.choice(choices)
        if rng.random() < 0.7:
            variant = {"price": rng.choice([125, 99999, "7.25", "1,250.00"]), "available": rng.random() < 0.5}
            if rng.random() < 0.6:
                variant["compare_at_price"] = rng.choice([100, 125, 200000, "8"])
            if rng.random() < 0.5:
                variant["sku"] = rng.choice(["", "S1", "0"])
            thing["variants"] = [variant, {"price": 1}]
        things.append(thing)
    page = '<script id="{}" type="application/json">{}</script>'
    names = ["ProductJSON", "productjson", "productJson-main-2"]
    got = values(spark, [page.format(rng.choice(names), json.dumps(t)) for t in things], E.embedded_products)
    assert [(p["name"], p.price, p.original_price, p.sku, p.in_stock, p.brand) for (p,) in got] == [
        expected_embedded(t) for t in things
    ]
    others = [page.format("product", '{"title":"x"}'), page.format("productjson", "[]"), page.format("productjson", "{"),
              page.format("productjson", '{"title":" "}'), '<script id="productjson">{"title":"x"}</script>']
    assert values(spark, others, E.embedded_products) == [[]] * len(others)


def test_markup_in_embedded_descriptions_becomes_text(spark):
    page = '<script id="productjson" type="application/json">' + json.dumps(
        {"title": "t", "description": "<ul><li>one</li><li>two &amp; three</ul>"}) + "</script>"
    df = parsed(spark, [page])
    (row,) = E.product_rows(df, E.extract_products(F.col("tree"), F.col("url"))).collect()
    assert row.description == "one two & three"


# --- cards and choice of source ------------------------------------------------------


def test_cards(spark):
    rng, pages, want = random.Random(24), [], []
    for k in range(50):
        tag, kind = rng.choice(["li", "div", "article", "section"]), rng.choice(["product", "my-Products x", "prod", ""])
        heading = rng.choice([f"<h{rng.randrange(1, 7)}>", None])
        price = rng.choice(['<span class="x PRICE">{}</span>', '<p class="price-old">{}</p>', '<b class="price">{}</b>', ""])
        link = rng.choice(['<a href="../{}">go</a>', '<a name="{}">go</a>', ""])
        title = f"{heading}Card <i>{k}</i></h{heading[2]}>" if heading else ""
        pages.append(f'<{tag} class="{kind}">{title}{price.format(f"now {k}.25, was 99")}{link.format(k)}</{tag}>')
        fits = tag in K.CARD_TAGS and "product" in kind.lower() and heading and heading[1:3] in K.CARD_HEADING_TAGS
        cost = Decimal(f"{k}.25") if price and "<b" not in price else None
        target = urljoin(URL, f"../{k}") if "href" in link else URL
        want.append([(f"Card{k}" if heading else None, cost, target)] if fits else [])
    got = values(spark, pages, E.generic_products)
    assert [[(p["name"], p.price, p.url) for p in page] for page in got] == want


def test_cards_need_prices_on_half_of_them(spark):
    priced = '<li class="product"><h1>a</h1><div class="price">3</div></li>'
    bare = '<li class="product"><h1>a</h1></li>'
    counts = [(p, b) for p in range(4) for b in range(6)]
    got = values(spark, [priced * p + bare * b for p, b in counts], lambda t, u: F.size(F.coalesce(E.extract_products(t, u), F.array())))
    assert got == [p + b if p + b and p >= max(1, (p + b) // 2) else 0 for p, b in counts]


def test_first_source_with_products_wins_and_the_rest_is_told_apart(spark):
    sources = [
        ("jsonld", ld({"@type": "Product", "name": "n"})),
        ("microdata", '<p itemscope itemtype="http://schema.org/Product"><b itemprop="name">n</b></p>'),
        ("embedded_json", '<script id="productjson" type="application/json">{"title":"n"}</script>'),
        ("generic_html", '<div class="product"><h2>n</h2><p class="price">1</p></div>'),
    ]
    rng, rows = random.Random(25), []
    for k in range(16):
        drawn = [s for b, s in enumerate(sources) if k >> b & 1]
        parts = [html for _, html in drawn]
        rng.shuffle(parts)
        rows.append((k, URL, "<body>" + "".join(parts), drawn[0][0] if drawn else None))
    rows += [(100, URL, "<p>x</p><![odd[x]]>", "broken"), (101, URL, None, None)]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id int, url string, html string")
    products, unresolved, errors = E.extract_pages(pages)
    assert {r.page_id: r.source for r in products.collect()} == {r[0]: r[3] for r in rows if r[3] not in (None, "broken")}
    assert {r.page_id for r in errors.collect()} == {100}
    assert {r.page_id for r in unresolved.collect()} == {0, 101}


def test_site_rule(spark, monkeypatch):
    rule = lambda tree, url: F.array(E._product("rule", name=F.concat(F.lit("from "), url)))
    monkeypatch.setitem(E.SITE_RULES, "ruled", rule)
    pages = spark.createDataFrame([(k, URL, s, "<p>") for k, s in enumerate(["ruled", "free", None])],
                                  "page_id int, url string, slug string, html string")
    products, unresolved, _ = E.extract_pages(pages, slug="slug")
    assert [(r.page_id, r["name"]) for r in products.collect()] == [(0, "from " + URL)]
    assert {r.page_id for r in unresolved.collect()} == {1, 2}


# --- promotions ----------------------------------------------------------------------

WORDS = ["free shipping", "5% off", "12 % OFF", "$3.50 off", "$x off", "coupon", "use code", "code: AB1", "sale", "sales",
         "on sale now", "bogo", "wholesale", "new", "clearance", "buy one get one", "100% cotton"]


def test_banners(spark):
    rng = random.Random(26)
    signal, hint = python_pattern(K.DISCOUNT_SIGNAL), python_pattern(K.BANNER_HINT)
    stated = [python_pattern(p) for p in (K.PERCENT_OFF, K.DOLLAR_OFF, K.COUPON_CODE)]
    pages, want = [], []
    for _ in range(60):
        page, expected = "", []
        for _ in range(rng.randrange(12)):
            tag = rng.choice(K.BANNER_TAGS + ["span", "li"])
            name, kind = rng.choice(["class", "id", "data-x"]), rng.choice(["hero", "xPromox", "top-bar", "topbar", "footer", "Marquee 2", ""])
            text = " \n ".join(rng.sample(WORDS, rng.randrange(4)) + ["filler"] * rng.choice([0, 0, 400]) + rng.sample(WORDS, 1))
            page += f'<{tag} {name}="{kind}">{text}</{tag}>'
            clean = " ".join(text.split())
            if tag in K.BANNER_TAGS and name != "data-x" and hint.search(kind) and signal.search(clean) and clean not in expected:
                expected.append(clean)
        pages.append(page)
        want.append([(t, any(p.search(t) for p in stated)) for t in expected])
    rows = E.campaign_rows(parsed(spark, pages)).orderBy("page_id", "pos").collect()
    got = [[(r.description, r.is_confident) for r in rows if r.page_id == k] for k in range(len(pages))]
    assert got == want
    assert max(map(len, want)) > 5 and max(len(t) for page in want for t, _ in page) > 1000


# --- signals, links and structure ----------------------------------------------------


def test_page_kind_follows_the_strongest_signal(spark):
    types = {"Product": "product", "CollectionPage": "category", "ItemList": "category", "Person": None}
    rng, pages, want = random.Random(27), [], []
    for _ in range(60):
        nodes = [rng.choice(list(types)) for _ in range(rng.randrange(3))]
        micro, meta, banner = (rng.random() < 0.3 for _ in range(3))
        og = rng.choice(["product", "PRODUCT", "website"])
        parts = [ld([{"@type": t} for t in nodes])]
        parts += ['<i itemtype="http://schema.org/Product"></i>'] * micro
        parts += [f'<meta content="{og}" property="og:type">'] * meta
        parts += ['<aside class="promo">bogo</aside>'] * banner
        rng.shuffle(parts)
        pages.append("".join(parts))
        first = next((types[t] for t in nodes if types[t]), None)
        want.append(first or ("product" if micro or meta and og.lower() == "product" else "promotional" if banner else "unknown"))
    assert values(spark, pages, lambda t, u: E.page_kind(t)) == want


def test_text_and_structure(spark):
    page = "<h1>one</h1>two<br>three&lt;<script>no</script><style>no</style><!-- no --> four <template>no</template>"
    assert values(spark, [page, "", "<p> </p>"], lambda t, u: N.page_text(t)) == ["one two three< four", "", ""]
    pages = spark.createDataFrame([(1, "<ol><li>a<li>b<b>c</ol>d<hr><em>")], "page_id int, html string")
    shape = {r.id: (r.tag, r.parent, r.end) for r in html_nodes(pages).collect()}
    assert shape == {0: ("ol", None, 3), 1: ("li", 0, 3), 2: ("li", 1, 3), 3: ("b", 2, 3), 4: ("hr", None, 4), 5: ("em", None, 5)}


@pytest.mark.parametrize("bad", ["<![foo[x]]>", "a<b><![ [", "<p>x</p><![temp[y]]><p>z</p>"])
def test_a_page_that_does_not_parse_is_an_error_row(spark, bad):
    pages = ["<p>fine</p>", bad, "<p>fine too</p>"]
    df = parsed(spark, pages)
    errors = page_errors(df).collect()
    assert len(errors) <= 1 and all(r.page_id == 1 and r.error for r in errors)
    texts = {r.page_id: r.t for r in df.select("page_id", N.page_text(F.col("tree")).alias("t")).collect()}
    assert (texts[0], texts[2]) == ("fine", "fine too")


def test_product_links(spark):
    rng, pages, want = random.Random(28), [], []
    hrefs = ["/products/a", "/product/b?c=1", "p/c", "/item/d#e", "/collections/f", "/sale/g", "h", "i/j", "/aisle/7", "/aisle/70/k",
             "//plants.example/products/l", "https://www.plants.example/p/m", "https://shop.example/products/n", "mailto:o@plants.example",
             "/products/a?utm_medium=q", "/blog/r"]
    for _ in range(30):
        drawn = rng.sample(hrefs, rng.randrange(len(hrefs)))
        pages.append("".join(f'<a href="{h}">x</a>' for h in drawn) + "<a>none</a>")
        links = set()
        for h in drawn:
            target = urlsplit(urljoin(URL, h))
            path = target.path
            kinds = [python_pattern(p).search(path) for p in (K.PRODUCT_PATH, K.PROMO_PATH, K.CATEGORY_PATH)]
            if target.netloc.removeprefix("www.") == "plants.example" and (kinds[0] or not any(kinds) and path.startswith("/aisle/7/")):
                query = "" if "utm" in target.query or not target.query else "?" + target.query
                links.add(f"{target.scheme}://{target.netloc}{path}{query}")
        want.append(links)
    got = [set() for _ in pages]
    for r in L.product_links(parsed(spark, pages)).collect():
        got[r.page_id].add(r.link)
    assert got == want


def test_sitemaps_with_prefixed_names(spark):
    ns = "http://www.sitemaps.org/schemas/sitemap/0.9"
    documents = {
        "plain": f'<urlset xmlns="{ns}" xmlns:i="urn:i"><url><i:loc>no</i:loc><loc>a</loc></url></urlset>',
        "prefixed": f"<?xml version='1.0'?><sm:urlset xmlns:sm='{ns}'><sm:url><sm:loc>a</sm:loc></sm:url>"
        f"<url><loc>no</loc></url><sm:url><sm:loc> b </sm:loc></sm:url></sm:urlset>",
        "index": f'<x.y:sitemapindex xmlns="urn:o" xmlns:x.y = "{ns}"><x.y:sitemap><x.y:loc>m</x.y:loc></x.y:sitemap>'
        "</x.y:sitemapindex>",
        "other": f'<sm:urlset xmlns="{ns}" xmlns:sm="urn:o"><sm:url><sm:loc>no</sm:loc></sm:url></sm:urlset>',
        "undeclared": "<sm:urlset><sm:url><sm:loc>no</sm:loc></sm:url></sm:urlset>",
        "cut": f"<sm:urlset xmlns:sm='{ns}'><sm:url><sm:loc>no",
        "empty": "",
        "null": None,
    }
    table = spark.createDataFrame(list(documents.items()), "sitemap_url string, xml string")
    got = {(r.sitemap_url, r.pos, r["loc"], r.is_index) for r in L.sitemap_locs(table).collect()}
    assert got == {
        ("plain", 0, "a", False), ("prefixed", 0, "a", False), ("prefixed", 1, "b", False), ("index", 0, "m", True),
    }


def test_sitemaps_of_any_depth_and_cycles(spark):
    chain = [(f"m{k}", True, 0, f"m{k + 1}") for k in range(12)] + [("m12", True, 1, "m0"), ("m12", True, 0, "leafy")]
    leaves = [("leafy", False, 3, "/deep"), ("m0", True, 9, "flat"), ("flat", False, 0, "/shallow"), ("flat", False, 1, "/deep")]
    locs = spark.createDataFrame(chain + leaves, "sitemap_url string, is_index boolean, pos int, loc string")
    roots = spark.createDataFrame([(1, "m0", 0), (2, "m12", 4)], "site int, sitemap_url string, pos int")
    got = {(r.site, r.url): r.depth for r in L.expand_sitemaps(roots, locs).collect()}
    assert got == {(1, "/shallow"): 1, (1, "/deep"): 1, (2, "/deep"): 1, (2, "/shallow"): 2}


def test_discovery_keeps_everything_and_numbers_it(spark):
    sites = spark.createDataFrame([(s, f"https://s{s}.example") for s in range(3)], "site int, base_url string")
    seeds = spark.createDataFrame([(0, 0, "/corner")], "site int, pos int, url string")
    leaves = spark.range(9000).select(
        (F.col("id") % 7 % 3).cast("int").alias("site"), F.array(F.col("id")).alias("trail"),
        F.concat(F.lit("/products/"), F.col("id") % 7000).alias("url"),
    )
    home = spark.createDataFrame([(1, 0, "/about"), (1, 1, "/products/1")], "site int, pos int, url string")
    found = L.discover_urls(sites, seeds, leaves, home)
    rows = found.collect()
    assert len(rows) == 1 + leaves.select("site", "url").union(home.select("site", "url")).distinct().count()
    for s in range(3):
        own = sorted((r for r in rows if r.site == s), key=lambda r: r.url_no)
        assert [r.url_no for r in own] == list(range(1, len(own) + 1))
        assert [(r.origin, r.trail) for r in own] == sorted((r.origin, r.trail) for r in own)
    frontier = L.crawl_frontier(found, {"product": 10, "unknown": 0}).collect()
    assert sorted((r.site, r.kind_no) for r in frontier if r.kind == "product") == [(s, k) for s in range(3) for k in range(1, 11)]
    assert {r.kind for r in frontier} == {"product", "category"}
    assert L.discover_urls(sites, seeds, leaves, home, limit=4).count() == 12


def test_a_site_from_its_stored_documents(spark):
    """Nested prefixed sitemaps, a cycle, a missing document, a site without any."""
    space = 'xmlns:m="' + K.SITEMAP_NAMESPACE + '"'

    def index(*locs):
        return f"<m:sitemapindex {space}>" + "".join(f"<m:sitemap><m:loc>{x}</m:loc></m:sitemap>" for x in locs) + "</m:sitemapindex>"

    urls = ["/products/1", "/pages/2", "https://other.example/products/3", "/pages/9"]
    maps = [
        (SITE + "/a.xml", index(SITE + "/b.xml", SITE + "/gone.xml")),
        (SITE + "/b.xml", index(SITE + "/a.xml", SITE + "/c.xml")),
        (SITE + "/c.xml", f"<m:urlset {space}>" + "".join(f"<m:url><m:loc>{u}</m:loc></m:url>" for u in urls) + "</m:urlset>"),
    ]
    frames = [
        spark.createDataFrame([(1, SITE), (2, "https://bare.example")], "site int, base_url string"),
        spark.createDataFrame([(1, 0, "/corner")], "site int, pos int, url string"),
        spark.createDataFrame([(1, f"Sitemap: {SITE}/a.xml")], "site int, text string"),
        spark.createDataFrame(maps, "sitemap_url string, xml string"),
        spark.createDataFrame([(1, '<a href="/pages/2">x</a><a href="/sale">s</a>')], "site int, html string"),
        spark.createDataFrame([(SITE + "/pages/2", '<meta property="og:type" content="product">')], "url string, html string"),
    ]
    rows = L.discover_site(*frames).orderBy("url_no").collect()
    kinds = {"/corner": "category", "/products/1": "product", "/pages/2": "product", "/pages/9": "unknown",
             "/sale": "promotional"}
    assert [(r.site, r.url.removeprefix(SITE), r.kind) for r in rows] == [(1, p, k) for p, k in kinds.items()]


def test_trees_of_a_batch_are_built_slice_by_slice(monkeypatch):
    """No more pages than a slice's are Python objects at a time; the trees are those of one slice."""
    batch = pa.array(["<ul id=u><li>a<li class>b</ul>", None, "", "<p>a</p><![x[y]]>", "<script>1</script>"] * 300)
    whole = sources.parse_html.func(batch).to_pylist()
    held, made = [], sources._Trees.arrow
    monkeypatch.setattr(sources, "SLICE_CHARS", 500)
    monkeypatch.setattr(sources._Trees, "arrow", lambda trees: held.append(len(trees.known)) or made(trees))
    assert sources.parse_html.func(batch).to_pylist() == whole
    assert sum(held) == len(batch) and max(held) < 100
    first, null, empty, odd, script = whole[:5]
    assert [(n["id"], n["tag"], n["parent"], n["end"], dict(n["attrs"])) for n in first["nodes"]] == [
        (0, "ul", None, 2, {"id": "u"}), (1, "li", 0, 2, {}), (2, "li", 1, 2, {"class": ""}),
    ]
    assert null is None and empty == {"nodes": [], "texts": [], "error": None}
    assert odd["nodes"] == [] and odd["texts"] == [] and odd["error"] and script["nodes"][0]["raw"] == "1"


def test_a_task_sends_trees_on_slice_by_slice(monkeypatch):
    """A large batch of pages leaves in slices, not as one array; all rows come, in order."""
    pages = [f"<ul id=u{k}><li>a</ul>" if k % 7 else None for k in range(1000)]
    monkeypatch.setattr(sources, "SLICE_CHARS", 500)
    sent = list(sources.parse_pages.func(iter([pa.array(pages), pa.array([], pa.string()), pa.array(pages[:3])])))
    assert max(len(s) for s in sent) < 100
    assert [t for s in sent for t in s.to_pylist()] == sources.parse_html.func(pa.array(pages + pages[:3])).to_pylist()


def test_trees_of_small_slices_keep_their_rows(spark):
    """Slices need not be the batches that Spark hands over."""
    rows = spark.range(60).selectExpr("id AS page_id", "'<b>' || repeat('x', 50000) || '</b><i>' || id || '</i>' AS html")
    got = with_tree(rows.coalesce(1)).selectExpr("page_id", "tree.texts[1] AS text").collect()
    assert len(got) == 60 and all(str(r.page_id) == r.text for r in got)

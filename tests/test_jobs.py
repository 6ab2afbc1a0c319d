"""Whole jobs on small inputs."""

import json
from datetime import datetime
from decimal import Decimal

from shelfwatch import schemas
from shelfwatch.jobs import extract_pages, import_feed
from shelfwatch.operators import crawl


def test_import_feed_job_can_be_run_again(spark, tmp_path):
    (tmp_path / "feed.csv").write_text("S1,5,bulb,Tulip,A,F25,10.00\nS1,5,bulb,Tulip,A,S26,NULL\n")
    (tmp_path / "brands.json").write_text(
        json.dumps([{"brand_num": 5, "slug": "a", "name": "other name", "website_url": "", "notes": ""}])
    )
    paths = {name: str(tmp_path / name) for name in ("sellers", "products", "observations")}
    now = datetime(2025, 1, 1)
    spark.createDataFrame([(1, "a", "A", "", "", now, False, None)], schemas.SELLERS).write.parquet(paths["sellers"])
    spark.createDataFrame([], schemas.PRODUCTS).write.parquet(paths["products"])
    spark.createDataFrame([], schemas.OBSERVATIONS).write.partitionBy("source").parquet(paths["observations"])
    args = {"feed_path": str(tmp_path / "feed.csv"), "observations": paths["observations"],
            "brands": str(tmp_path / "brands.json")}
    first = import_feed.run(spark, sellers=paths["sellers"], products=paths["products"], **args)
    assert [(r.slug, r["name"], r.is_own_brand, r.brand_num) for r in spark.read.parquet(first["sellers"]).collect()] == [
        ("a", "A", True, 5)
    ]
    second = import_feed.run(spark, sellers=first["sellers"], products=first["products"], **args)
    assert spark.read.parquet(second["products"]).count() == 1
    rows = spark.read.parquet(paths["observations"]).collect()
    assert sorted((r.price, r.in_stock) for r in rows if r.price) == [(Decimal("10.00"), True)] and len(rows) == 2


def test_extract_pages_job(spark, tmp_path):
    pages = [(1, "https://x.example/a", '<script type="application/ld+json">{"@type":"Product","name":"A"}</script>'),
             (2, "https://x.example/b", '<p class="promo">sale 10% off</p>'), (3, "https://x.example/c", "<p><![foo[x]]>")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages"))
    out = str(tmp_path / "out")
    extract_pages.run(spark, str(tmp_path / "pages"), out)
    assert [r["name"] for r in spark.read.parquet(out + "/products").collect()] == ["A"]
    assert [r.discount_text for r in spark.read.parquet(out + "/campaigns").collect()] == ["10% off"]
    signals = {r.page_id: (r.kind, r.products) for r in spark.read.parquet(out + "/page_signals").collect()}
    assert signals == {1: ("product", 1), 2: ("promotional", 0)}
    assert [r.page_id for r in spark.read.parquet(out + "/page_errors").collect()] == [3]


def test_first_import_creates_the_brands_it_needs(spark, tmp_path):
    (tmp_path / "feed.csv").write_text("S1,5,bulb,Tulip,A,F25,10.00\nS1,6,bulb,Other tulip,A,F25,11.00\n")
    brands = [{"brand_num": n, "slug": f"b{n}", "name": f"B{n}", "website_url": "", "notes": ""} for n in (5, 6)]
    (tmp_path / "brands.json").write_text(json.dumps(brands))
    for name, schema in (("sellers", schemas.SELLERS), ("products", schemas.PRODUCTS), ("observations", schemas.OBSERVATIONS)):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    args = {"feed_path": str(tmp_path / "feed.csv"), "observations": str(tmp_path / "observations"), "brands": str(tmp_path / "brands.json")}
    out = import_feed.run(spark, sellers=str(tmp_path / "sellers"), products=str(tmp_path / "products"), **args)
    sellers = {r.slug: r for r in spark.read.parquet(out["sellers"]).collect()}
    assert set(sellers) == {"b5", "b6"} and len({r.seller_id for r in sellers.values()}) == 2
    assert all(r.seller_id is not None and r.created_at is not None for r in sellers.values())
    products = {r["name"]: r.seller_id for r in spark.read.parquet(out["products"]).collect()}
    assert products == {"Tulip": sellers["b5"].seller_id, "Other tulip": sellers["b6"].seller_id}


def test_ingest_listing_pages(spark):
    def card(name, price):
        return f'<div class="product"><h3>{name}</h3><p class="price">${price}</p><a href="/products/{name}">x</a></div>'

    banner = '<div class="announcement-bar">20% off all</div>'
    base = "https://x.example"
    html = [
        banner + card("tulip", "1.00") + card("rose", "2.00") + '<a rel="next" href="?page=2">n</a>',
        banner + "lorem ipsum dolor sit amet " * 9 + card("rose", "2.00") + card("lily", "33.50"),
        card("never", "9.00"),
    ]
    when = datetime(2026, 1, 1)
    pages = spark.createDataFrame(
        [("list", i, 1, "x", base, f"{base}/shop?page={i + 1}", h, when) for i, h in enumerate(html)],
        "crawl string, page_idx int, seller_id bigint, slug string, base_url string, url string, html string, "
        "fetched_at timestamp_ntz",
    )
    products = spark.createDataFrame(
        [(10, 1, None, "rose", "", "", when, when)],
        "product_id bigint, seller_id bigint, sku string, name string, category string, url string, "
        "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz",
    )
    campaigns = spark.createDataFrame([], "seller_id bigint, product_id bigint, discount_text string")
    result = crawl.ingest_pages(pages, products, campaigns)
    assert {(r["name"], r.is_new) for r in result.products.collect()} == {
        ("tulip", True), ("rose", False), ("lily", True)
    }
    assert sorted(r.price for r in result.observations.collect()) == [1, 2, Decimal("33.50")]
    assert [(r.discount_text, r.seller_id) for r in result.campaigns.collect()] == [("20% off", 1)]
    assert {r.url for r in result.product_links.collect()} == {f"{base}/products/{n}" for n in ("tulip", "rose", "lily")}
    assert [(r.page_idx, r.stop_reason) for r in result.pages.orderBy("page_idx").collect()] == [
        (0, None), (1, "no_next_link")
    ]

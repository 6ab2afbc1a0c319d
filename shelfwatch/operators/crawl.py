"""Stored pages of crawl runs to products, observations, promotions, links and run rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import tree as N
from ..functions.text import blank_to_null, price_context
from ..session import materialise, spread
from ..sources.pages import with_tree
from . import extraction as E, links as L, matching as M, pagination as G
from .campaigns import new_campaigns

_PAGE = ["crawl", "page_idx"]
# Listings come first, then product pages, promotion pages and the homepage.
_KINDS = ["category", "product", "promo", "homepage"]
_ORDER = ["kind_no", "crawl", "page_idx", "url", "pos"]
_BANNER_ORDER = ["kind_no", "crawl", "page_idx", "source_url", "pos"]


@dataclass
class CrawlResult:
    """What crawls add; ``products`` is the whole product table after them."""

    products: DataFrame
    observations: DataFrame
    campaigns: DataFrame
    ambiguous_banners: DataFrame
    product_links: DataFrame
    unresolved_pages: DataFrame
    pages: DataFrame
    page_errors: DataFrame
    runs: DataFrame | None = None
    run_errors: DataFrame | None = None


def _facts(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Every page parsed once, and what was read off it written to the shared folder."""
    tree, url = F.col("tree"), F.col("url")
    fetch_error = F.col("fetch_error") if "fetch_error" in pages.columns else F.lit(None).cast("string")
    facts = with_tree(spread(pages)).select(
        *keys, "seller_id", "base_url", "url", "fetched_at",
        F.coalesce(fetch_error, tree["error"]).alias("error"),
        fetch_error.isNull().alias("fetched"),
        E.extract_products(tree, url, F.col("slug")).alias("products"),
        price_context(N.page_text(tree)).alias("context"),
        E.next_link(tree, url).alias("next_url"),
        E.anchor_hrefs(tree).alias("hrefs"),
        E.banner_texts(tree).alias("banners"),
    )
    return materialise(facts, "page-facts")


def ingest_pages(pages: DataFrame, products: DataFrame, campaigns: DataFrame) -> CrawlResult:
    """Take in listing pages alone.

    ``pages``: crawl (one listing of one seller), page_idx, seller_id, slug,
    base_url, url, html, fetched_at.
    """
    listed = pages.withColumn("run_id", F.lit(None).cast("string")).withColumn("kind", F.lit("category"))
    return ingest_run(listed, products, campaigns)


def ingest_run(
    pages: DataFrame,
    products: DataFrame,
    campaigns: DataFrame,
    discovery_errors: DataFrame | None = None,
) -> CrawlResult:
    """Take in all pages of any number of crawl runs.

    ``pages``: run_id, kind (category, product, promo or homepage), crawl (the
    listing a category page belongs to, else null), page_idx, seller_id, slug,
    base_url, url, html, fetched_at and, if there were any, fetch_error (html is
    null then). ``discovery_errors``: run_id, error of runs whose discovery broke.

    The stop rule decides which pages of a listing count; a page that was not
    fetched or does not parse ends its listing and spoils nothing else. Listing
    and product pages give products, listing and promotion pages and the
    homepage give promotions.
    """
    kind_no = F.array_position(F.array(*[F.lit(k) for k in _KINDS]), F.col("kind"))
    keys = ["run_id", "kind", *_PAGE]
    facts = _facts(pages, keys).withColumn("kind_no", kind_no)
    sound = facts.where("error IS NULL")
    listing = facts.where("kind = 'category'")

    items = _items(sound)
    listed = items.where("kind_no = 1")
    links = L.product_links(
        listing.where("error IS NULL"), "crawl", "run_id", "page_idx", hrefs=F.col("hrefs")
    ).withColumnRenamed("link", "url")
    visited = materialise(
        G.pagination_stop(listing.select(*_PAGE, "url", "next_url", "context", "error"), listed, links), "visited"
    )
    giving = visited.where("gives_products").select(*_PAGE)
    scanned = visited.where("gives_promotions").select(*_PAGE)

    from_listings = G.first_seen(listed.join(giving, _PAGE, "left_semi"), "name")
    sightings = from_listings.unionByName(items.where("kind_no = 2"))
    placed, after = M.find_or_create(sightings, products, _ORDER, "fetched_at")

    with_banners = listing.join(scanned, _PAGE, "left_semi").unionByName(sound.where("kind IN ('promo', 'homepage')"))
    banners = E.campaign_rows(
        with_banners, "run_id", "kind_no", "crawl", "page_idx", "seller_id", texts=F.col("banners")
    ).withColumn("product_id", F.lit(None).cast("bigint"))
    confident = banners.where("is_confident").drop("is_confident")
    runs, run_errors = _runs(facts, visited, discovery_errors)
    return CrawlResult(
        products=after,
        observations=M.crawl_observations(placed.withColumnRenamed("fetched_at", "observed_at")),
        campaigns=new_campaigns(confident, campaigns, _BANNER_ORDER).drop("kind_no", "crawl", "page_idx", "pos"),
        ambiguous_banners=banners.where("NOT is_confident").drop("is_confident", "discount_text"),
        product_links=links.join(scanned, _PAGE, "left_semi").select("run_id", "crawl", "url").distinct(),
        unresolved_pages=sound.where("products IS NULL AND kind_no <= 2").select(*keys, "url"),
        pages=visited,
        page_errors=facts.where("error IS NOT NULL").select(*keys, "url", "error"),
        runs=runs,
        run_errors=run_errors,
    )


def _items(sound: DataFrame) -> DataFrame:
    """Products read off sound listing and product pages; an item without an address has its page's."""
    pages = sound.where("kind_no <= 2").withColumn("page_url", F.col("url"))
    rows = E.product_rows(
        pages, F.col("products"), "run_id", "kind_no", "crawl", "page_idx", "seller_id", "fetched_at", "page_url"
    )
    return rows.withColumn("url", F.coalesce(blank_to_null(F.col("url")), "page_url")).drop("page_url")


def _runs(
    facts: DataFrame, visited: DataFrame, discovery_errors: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """(run rows, error lines). A listing is one unit of a run, like any other page."""
    reached = facts.where("kind = 'category'").join(visited.select(*_PAGE), _PAGE, "left_semi")
    start = F.min_by("url", "page_idx")
    listings = reached.groupBy("run_id", "kind", "crawl").agg(
        start.alias("url"), F.max("error").alias("error")
    )
    columns = ["run_id", "kind", "url", "error", "fetched"]
    units = listings.withColumn("fetched", F.col("error").isNull()).select(*columns).unionByName(
        facts.where("kind <> 'category'").select(*columns)
    )
    if discovery_errors is not None:
        lost = discovery_errors.select("run_id", F.lit("discovery").alias("kind"), F.lit("").alias("url"), "error")
        units = units.unionByName(lost.withColumn("fetched", F.lit(False)))
    units = materialise(units, "crawl-units")
    span = facts.groupBy("run_id").agg(
        F.min("seller_id").alias("seller_id"), F.min("fetched_at").alias("started_at"), F.max("fetched_at").alias("finished_at")
    )
    return G.crawl_outcome(units).join(span, "run_id", "left"), G.crawl_errors(units)

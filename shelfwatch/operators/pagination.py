"""Crawl page sequences: new items and links, recycled pages, where to stop, outcome.

A crawl's pages are ordered by ``page_idx``. A listing may have any number of
pages: they are numbered and met with their predecessors in ranges, and only a
page's price context moves, never its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.ranking import number_rows
from ..functions.similarity import context_pieces, print_similarity
from ..functions.text import price_context
from ..session import materialise


def first_seen(rows: DataFrame, value: str) -> DataFrame:
    """Rows whose ``value`` was not on an earlier page of the crawl.

    Equal values on the same page all pass. The first page per value is found
    by aggregation, so a value on very many pages is no burden.
    """
    first = rows.groupBy("crawl", value).agg(F.min("page_idx").alias("page_idx"))
    return rows.join(first, ["crawl", value, "page_idx"], "left_semi")


def new_per_page(rows: DataFrame, value: str, count_name: str) -> DataFrame:
    """Distinct new values per page."""
    first = rows.groupBy("crawl", value).agg(F.min("page_idx").alias("page_idx"))
    return first.groupBy("crawl", "page_idx").agg(F.count("*").alias(count_name))


def _listing(pages: DataFrame, max_pages: int | None) -> DataFrame:
    """Pages with their number in the crawl and their likeness to the page before."""

    def cut(dealt: DataFrame) -> DataFrame:
        return dealt.withColumn("pieces", context_pieces(F.col("context"))).drop("context")

    likeness = ("pieces", "similarity", print_similarity)
    numbered = number_rows(pages, ["crawl"], [F.col("page_idx")], "page_no", cut, likeness)
    if max_pages is not None:
        numbered = numbered.where(F.col("page_no") <= max_pages)
    recycled = F.coalesce(F.col("similarity") > K.RECYCLED_SIMILARITY, F.lit(False))
    return numbered.withColumn("is_recycled", recycled)


def recycled_pages(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Every listing page against its predecessor's price context.

    ``pages`` has one row per (crawl, page_idx) with the page's whole text.
    """
    prints = pages.select("crawl", "page_idx", price_context(F.col("text")).alias("context"))
    return _listing(prints, max_pages).select("crawl", "page_idx", "similarity", "is_recycled")


def pagination_stop(
    pages: DataFrame, items: DataFrame, links: DataFrame, max_pages: int | None = None
) -> DataFrame:
    """Which pages of each listing crawl were visited, used and why it stopped.

    ``pages``: crawl, page_idx, url, next_url, context (see ``price_context``)
    and, if pages may be broken, error.
    ``items``: crawl, page_idx, name. ``links``: crawl, page_idx, url.

    A page is reached when no earlier page stopped the crawl. Before anything
    is taken from it, a revisited url or a recycled price context stops the
    crawl. A page with nothing new on either front still gives its promotions
    and then stops. A page without a next link is the last one, and so is page
    ``max_pages`` if a limit is given.
    """
    listing = materialise(_listing(pages, max_pages).drop("similarity"), "listing")
    first_visit = listing.groupBy("crawl", "url").agg(F.min("page_idx").alias("first_idx"))
    listing = listing.join(first_visit, ["crawl", "url"], "left").withColumn(
        "is_revisit", F.coalesce(F.col("page_idx") > F.col("first_idx"), F.lit(False))
    )
    counted = (
        listing.join(new_per_page(items, "name", "new_items"), ["crawl", "page_idx"], "left")
        .join(new_per_page(links, "url", "new_links"), ["crawl", "page_idx"], "left")
        .fillna(0, subset=["new_items", "new_links"])
    )
    nothing_new = (F.col("new_items") == 0) & (F.col("new_links") == 0)
    broken = F.col("error").isNotNull() if "error" in pages.columns else F.lit(False)
    reason = (
        F.when(F.col("is_revisit"), "revisited")
        .when(broken, "failed")
        .when(F.col("is_recycled"), "recycled")
        .when(nothing_new, "nothing_new")
        .when(F.col("next_url").isNull(), "no_next_link")
    )
    if max_pages is not None:
        reason = reason.when(F.col("page_no") == max_pages, "page_cap")
    flagged = materialise(
        counted.select("crawl", "page_idx", "page_no", "new_items", "new_links", reason.alias("stop_reason")), "flagged"
    )
    stops = flagged.where("stop_reason IS NOT NULL").groupBy("crawl").agg(F.min("page_no").alias("stop_at"))
    reached = flagged.join(stops, "crawl", "left").where("stop_at IS NULL OR page_no <= stop_at")
    scanned = ~F.coalesce(F.col("stop_reason").isin("revisited", "failed", "recycled"), F.lit(False))
    return reached.select(
        "crawl",
        "page_idx",
        "new_items",
        "new_links",
        "stop_reason",
        scanned.alias("gives_promotions"),
        (scanned & ~nothing_new).alias("gives_products"),
    )


def crawl_outcome(units: DataFrame) -> DataFrame:
    """Status of every crawl run from its url outcomes.

    ``units``: run_id, kind (category, product, promo, homepage or discovery),
    url, error (null when fine) and fetched (page counted before any failure).
    Error texts are listed by ``crawl_errors``, one row each.
    """
    failed = F.col("error").isNotNull()
    fetched = F.col("fetched")
    return (
        units.groupBy("run_id")
        .agg(
            F.count_if(fetched).alias("pages_fetched"),
            F.count_if(failed).alias("errors"),
            F.count_if(failed & (F.col("kind") == "discovery")).alias("discovery_errors"),
        )
        .select("run_id", "pages_fetched", "errors", _status().alias("status"))
    )


def _status() -> Column:
    nothing_worked = (F.col("errors") > 0) & (F.col("pages_fetched") == 0)
    return (
        F.when(nothing_worked | (F.col("discovery_errors") > 0), "failed")
        .when(F.col("errors") > 0, "partial_failure")
        .otherwise("success")
    )


def crawl_errors(units: DataFrame) -> DataFrame:
    """One log line per failed url."""
    what = (
        F.when(F.col("kind") == "discovery", F.concat(F.lit("discovery: "), "error"))
        .when(F.col("kind") == "homepage", F.concat(F.lit("homepage "), "url", F.lit(": fetch failed")))
        .otherwise(F.concat("kind", F.lit(" "), "url", F.lit(": fetch/extract failed")))
    )
    return units.where(F.col("error").isNotNull()).select("run_id", what.alias("line"))


def merge_passes(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per (page, name) over several extraction passes.

    The first occurrence wins, unless it has no price and a later one does;
    then the first priced one wins.
    """
    columns = [c for c in rows.columns if c not in ("page", "name")]
    best = F.min_by(F.struct(*columns), F.struct(F.col("price").isNull(), *order)).alias("best")
    return rows.groupBy("page", "name").agg(best).select("page", "name", "best.*")

"""Links and URL discovery: product links, sitemaps and the crawl frontier.

Everything found is kept and numbered; a caller that wants fewer rows passes a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X, tree as N, urls as U
from ..functions.ranking import number_rows
from .. import constants as K
from ..session import materialise, sorted_parts
from ..sources.pages import with_tree
from .extraction import anchor_hrefs, page_kind


def links(
    pages: DataFrame, key: str = "page_id", *kept: str, hrefs: Column | None = None
) -> DataFrame:
    """(page, position, href, link) of every anchor; link is the normalised target.

    The hrefs come from the page's ``tree`` unless a column of them is given.
    """
    found = anchor_hrefs(F.col("tree")) if hrefs is None else hrefs
    rows = pages.select(
        key, *kept, F.col("url").alias("page_url"), F.posexplode(found).alias("pos", "href")
    )
    return rows.withColumn("link", U.link_target(F.col("page_url"), F.col("href")))


def product_links(
    pages: DataFrame, key: str = "page_id", *kept: str, hrefs: Column | None = None
) -> DataFrame:
    """Distinct product links per page.

    ``pages`` also has ``base_url``, the seller's address. A link counts when it
    stays on the site and either looks like a product path, or is unclassified
    and lies strictly below the page's own path.
    """
    rows = links(pages, key, "base_url", *kept, hrefs=hrefs)
    rows = rows.where(U.same_site(F.col("link"), F.col("base_url"))).withColumn(
        "kind", U.kind_by_path(F.col("link"))
    )
    page_path = F.regexp_replace(U.path(F.col("page_url")), "/+$", "")
    below = (
        (F.col("kind") == "unknown")
        & (page_path != "")
        & F.startswith(U.path(F.col("link")), F.concat(page_path, F.lit("/")))
    )
    return rows.where((F.col("kind") == "product") | below).select(key, *kept, "link").distinct()


# --- robots.txt and sitemaps -------------------------------------------------


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Declared sitemaps of every site, in file order. ``robots``: site, text."""
    lines = F.split("text", r"\r\n|\r|\n", -1)
    declared = F.filter(lines, lambda line: F.lower(line).startswith("sitemap:"))
    rows = robots.select("site", F.posexplode(declared).alias("pos", "line"))
    location = X.strip(F.regexp_replace("line", r"(?s)^[^:]*:", ""))
    return rows.select("site", "pos", location.alias("sitemap_url"))


def sitemap_roots(robots: DataFrame, sites: DataFrame) -> DataFrame:
    """Declared sitemaps, then the conventional /sitemap.xml, each once per site.

    ``sites``: site, base_url.
    """
    conventional = sites.select(
        "site",
        F.lit(2**31 - 1).alias("pos"),
        U.resolve(F.col("base_url"), F.lit("/sitemap.xml")).alias("sitemap_url"),
    )
    return (
        robots_sitemaps(robots)
        .unionByName(conventional)
        .groupBy("site", "sitemap_url")
        .agg(F.min("pos").alias("pos"))
    )


_SITEMAP_SCHEMA = ", ".join(
    f"`{prefix}{entry}` array<struct<`{prefix}loc`: string>>" for prefix in ("", "smap:") for entry in ("url", "sitemap")
)
_ROOT = r"<(?:([A-Za-z_][\w.-]*):)?(?:urlset|sitemapindex)\b([^>]*)>"


def sitemap_locs(documents: DataFrame) -> DataFrame:
    """(sitemap_url, pos, loc, is_index) of stored sitemaps; malformed ones give none.

    ``documents``: sitemap_url, xml. The sitemap namespace may be the default one or
    have a prefix. A root element outside it gives none, nor do entries outside it.
    """
    prefix, declared = F.regexp_extract("xml", _ROOT, 1), F.regexp_extract("xml", _ROOT, 2)
    own = F.when(prefix == "", "").otherwise(F.concat(F.lit(r":\Q"), prefix, F.lit(r"\E")))
    value = F.concat(F.lit(r"(?:^|\s)xmlns"), own, F.lit(r"""\s*=\s*["']([^"']*)["']"""))
    named = F.call_function("regexp_extract", declared, value, F.lit(1)) == K.SITEMAP_NAMESPACE
    # A prefix is a free name, so it is spelt in one way for the parser.
    tag = F.concat(F.lit(r"(</?)\Q"), prefix, F.lit(r"\E:"))
    spelt = F.when(prefix == "", F.col("xml")).otherwise(
        F.call_function("regexp_replace", F.col("xml"), tag, F.lit("$1smap:"))
    )
    parsed = documents.where(named).select(
        "sitemap_url", (prefix == "").alias("plain"), F.from_xml(spelt, F.lit(_SITEMAP_SCHEMA)).alias("x")
    )
    entry = {
        name: F.when(F.col("plain"), F.col(f"x.{name}.loc")).otherwise(F.col(f"x.`smap:{name}`.`smap:loc`"))
        for name in ("url", "sitemap")
    }
    is_index = entry["sitemap"].isNotNull()
    entries = F.when(is_index, entry["sitemap"]).otherwise(entry["url"])
    rows = parsed.select(
        "sitemap_url", is_index.alias("is_index"), F.posexplode(entries).alias("pos", "loc")
    )
    location = X.strip(F.col("loc"))
    return rows.withColumn("loc", location).where(
        F.col("loc").isNotNull() & (F.col("loc") != "")
    )


def expand_sitemaps(roots: DataFrame, locs: DataFrame) -> DataFrame:
    """Leaf urls below each site's sitemaps: (site, url, depth, trail).

    Roots are depth 0. Nested indexes are followed, each sitemap once per site
    at its first depth, until a level finds none that is new; that also ends
    cycles. ``trail`` (positions from the root) gives the order of first
    discovery. Levels are written, so a deep tree is no long plan.
    """
    locs = materialise(locs, "sitemap-locs")  # read at every level, parsed once
    frontier = roots.select("site", "sitemap_url", F.array(F.col("pos").cast("long")).alias("trail"))
    frontier = materialise(frontier, "sitemap-frontier")
    visited = frontier.select("site", "sitemap_url")
    leaves, depth = None, 0
    while True:
        found = frontier.join(locs, "sitemap_url").select(
            "site",
            "loc",
            "is_index",
            F.concat("trail", F.array(F.col("pos").cast("long"))).alias("trail"),
        )
        level = (
            found.where(~F.col("is_index"))
            .groupBy("site", F.col("loc").alias("url"))
            .agg(F.min("trail").alias("trail"))
            .withColumn("depth", F.lit(depth))
        )
        level = materialise(level, "sitemap-leaves")
        leaves = level if leaves is None else leaves.unionByName(level)
        further = (
            found.where("is_index")
            .groupBy("site", F.col("loc").alias("sitemap_url"))
            .agg(F.min("trail").alias("trail"))
            .join(visited, ["site", "sitemap_url"], "left_anti")
        )
        frontier = materialise(further, "sitemap-frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("site", "sitemap_url"))
        depth += 1
    return leaves.groupBy("site", "url").agg(
        F.min("depth").alias("depth"), F.min("trail").alias("trail")
    )


# --- discovery ---------------------------------------------------------------


def homepage_links(homepages: DataFrame, limit: int | None = None) -> DataFrame:
    """The hrefs of every homepage (the first ``limit`` if given). ``homepages``: site, tree."""
    hrefs = anchor_hrefs(F.col("tree"))
    if limit is not None:
        hrefs = F.slice(hrefs, 1, limit)
    return homepages.select("site", F.posexplode(hrefs).alias("pos", "url")).where("url <> ''")


def discover_urls(
    sites: DataFrame,
    seeds: DataFrame,
    leaves: DataFrame,
    homepage: DataFrame,
    limit: int | None = None,
) -> DataFrame:
    """Every site's urls by kind, first added wins, numbered in order of discovery.

    ``sites``: site, base_url. The sources are added in order: ``seeds`` (site,
    pos, url; an unclassified seed is a category), sitemap ``leaves`` (site,
    trail, url), ``homepage`` links (site, pos, url). Urls of other sites are
    dropped, and duplicates fall together under their normal form.
    """
    position = F.array(F.col("pos").cast("long"))
    added = (
        seeds.select("site", "url", F.lit(0).alias("origin"), position.alias("trail"))
        .unionByName(leaves.select("site", "url", F.lit(1).alias("origin"), "trail"))
        .unionByName(homepage.select("site", "url", F.lit(2).alias("origin"), position.alias("trail")))
    )
    # One row per spelling first: it is cheaper to drop repeats than to parse them.
    spellings = added.groupBy("site", "url").agg(F.min(F.struct("origin", "trail")).alias("f"))
    bases = sites.select("site", "base_url", U.site(F.col("base_url")).alias("base_site"))
    raw_kind = U.kind_by_path(F.col("url"))
    is_seed = (F.col("f.origin") == 0) & (raw_kind == "unknown")
    placed = spellings.join(bases, "site").select(
        "site",
        "base_site",
        U.link_target(F.col("base_url"), F.col("url")).alias("link"),
        F.struct("f.*", F.when(is_seed, "category").otherwise(raw_kind).alias("kind")).alias("f"),
    )
    on_site = placed.where(U.site(F.col("link")) == F.col("base_site"))
    # Dealt anew before they are sorted by link: a task that has sorted spellings sorts nothing else.
    parts = sorted_parts(added)
    dealt = on_site.select("site", F.col("link").alias("url"), "f")
    dealt = dealt.repartition(*([] if parts is None else [parts]), "site", "url")
    first = dealt.groupBy("site", "url").agg(F.min("f").alias("f"))
    rows = first.select("site", "url", "f.origin", "f.trail", "f.kind")
    order = [F.col("origin"), F.col("trail"), F.col("url")]
    numbered = number_rows(rows, ["site"], order, "url_no")
    return numbered if limit is None else numbered.where(F.col("url_no") <= limit)


def crawl_frontier(discovered: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Discovered urls numbered inside their site and kind.

    ``limits`` keeps only the first so many of a kind, 0 none of it.
    """
    numbered = number_rows(discovered, ["site", "kind"], [F.col("url_no")], "kind_no")
    for kind, limit in (limits or {}).items():
        numbered = numbered.where((F.col("kind") != kind) | (F.col("kind_no") <= limit))
    return numbered


def product_url_frontier(category_links: DataFrame, discovered: DataFrame) -> DataFrame:
    """Distinct product urls from category pages and from discovery. Both: site, url."""
    sitemap = discovered.where(F.col("kind") == "product").select("site", "url")
    return category_links.select("site", "url").union(sitemap).distinct()


def kind_counts(discovered: DataFrame) -> DataFrame:
    kinds = ["product", "category", "promotional", "unknown"]
    return (
        discovered.groupBy("site").pivot("kind", kinds).count().fillna(0, subset=kinds)
    )


def discover_site(
    sites: DataFrame,
    seeds: DataFrame,
    robots: DataFrame,
    sitemaps: DataFrame,
    homepages: DataFrame,
    pages: DataFrame,
    limit: int | None = None,
) -> DataFrame:
    """Discovery from stored documents to classified urls, for all sites at once.

    ``sites``: site, base_url. ``seeds``: site, pos, url. ``robots``: site, text.
    ``sitemaps``: sitemap_url, xml. ``homepages``: site, html. ``pages``: url
    (normalised), html. Seeds come first, then the urls below the sitemaps that
    robots.txt declares or that stand at the usual address, then the homepage's
    links; what the path leaves unclassified is judged by its stored page. A site
    without one of the documents goes without that source.
    """
    leaves = expand_sitemaps(sitemap_roots(robots, sites), sitemap_locs(sitemaps))
    home = homepage_links(with_tree(homepages.select("site", "html")))
    return reclassify_by_page(discover_urls(sites, seeds, leaves, home, limit), pages)


def reclassify_by_page(discovered: DataFrame, pages: DataFrame) -> DataFrame:
    """Kinds of unclassified urls corrected by stored page content.

    ``pages``: url (normalised), html. Only pages of unclassified urls are
    parsed; a url without a stored page stays unknown.
    """
    unknown = discovered.where(F.col("kind") == "unknown").select("url").distinct()
    signals = with_tree(pages.join(unknown, "url", "left_semi")).select(
        "url", page_kind(F.col("tree")).alias("judged")
    )
    judged = signals.groupBy("url").agg(F.min("judged").alias("judged"))
    kind = F.when(F.col("kind") == "unknown", F.coalesce("judged", "kind")).otherwise(F.col("kind"))
    return discovered.join(judged, "url", "left").withColumn("kind", kind).drop("judged")

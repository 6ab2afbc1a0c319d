"""Sellers: registry loading, overview, dashboard, paging and name resolution."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.ranking import number_rows, top_n
from ..functions.text import seller_slug_guess
from .ids import assign_ids


def active_only(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("active"))


def _with_ids(fresh: DataFrame, sellers: DataFrame) -> DataFrame:
    """New sellers with ids above the known ones, if sellers have ids at all."""
    return assign_ids(fresh, sellers, "seller_id", ["slug"]) if "seller_id" in sellers.columns else fresh


def seed_sellers(registry: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing sellers plus the active registry entries whose slug is not there yet."""
    fresh = active_only(registry).drop("active").join(existing, "slug", "left_anti")
    return existing.unionByName(_with_ids(fresh, existing), allowMissingColumns=True)


def upsert_own_brands(sellers: DataFrame, own_brands: DataFrame) -> DataFrame:
    """Mark own brands by slug, adding missing ones under new ids.

    Only ``is_own_brand`` and ``brand_num`` are set on a seller that exists; its
    name, address and notes stay.
    """
    numbers = own_brands.select("slug", F.col("brand_num").alias("own_num"))
    matched = F.col("own_num").isNotNull()
    known = sellers.join(numbers, "slug", "left").select(
        *[F.col(c) for c in sellers.columns if c not in ("is_own_brand", "brand_num")],
        (matched | F.coalesce("is_own_brand", F.lit(False))).alias("is_own_brand"),
        F.coalesce("own_num", "brand_num").alias("brand_num"),
    )
    fresh = own_brands.join(sellers, "slug", "left_anti").withColumn("is_own_brand", F.lit(True))
    return known.unionByName(_with_ids(fresh, sellers), allowMissingColumns=True)


def by_slug(sellers: DataFrame, slug: str) -> DataFrame:
    return sellers.where(F.col("slug") == slug)


def product_by_id(products: DataFrame, product_id: int) -> DataFrame:
    return products.where(F.col("product_id") == product_id)


def product_counts(products: DataFrame) -> DataFrame:
    return products.groupBy("seller_id").agg(F.count("product_id").alias("product_count"))


def latest_crawl(crawl_runs: DataFrame) -> DataFrame:
    """The newest crawl of every seller (ties: highest run id)."""
    newest = F.max(F.struct("started_at", "run_id", "status")).alias("newest")
    return crawl_runs.groupBy("seller_id").agg(newest).select("seller_id", "newest.*")


def seller_overview(sellers: DataFrame, products: DataFrame, crawl_runs: DataFrame) -> DataFrame:
    """Sellers with product count (0 when none) and last crawl (null when none)."""
    labels = F.create_map(*[F.lit(x) for x in chain(*K.STATUS_LABELS.items())])
    last = latest_crawl(crawl_runs).select(
        "seller_id",
        F.col("started_at").alias("last_crawled_at"),
        F.col("status").alias("last_crawl_status"),
    )
    return (
        sellers.join(product_counts(products), "seller_id", "left")
        .join(last, "seller_id", "left")
        .withColumn("product_count", F.coalesce("product_count", F.lit(0)))
        .withColumn("status_label", labels[F.col("last_crawl_status")])
    )


def dashboard_stats(overview: DataFrame) -> DataFrame:
    """Rivals, own brands, products in all and sellers whose last crawl had trouble."""
    trouble = F.col("last_crawl_status").isin("partial_failure", "failed")
    return overview.agg(
        F.count_if(~F.col("is_own_brand")).alias("rivals"),
        F.count_if(F.col("is_own_brand")).alias("own_brands"),
        F.coalesce(F.sum("product_count"), F.lit(0)).alias("total_products"),
        F.count_if(trouble).alias("needs_attention"),
    )


def product_page(
    products: DataFrame,
    observations: DataFrame,
    order: list[str],
    seller_id: int,
    limit: int = K.DEFAULT_PAGE_SIZE,
    offset: int = 0,
) -> DataFrame:
    """One page of a seller's products by name, each with its latest observation.

    The page is cut first; only its products' observations are then read, by a
    join on at most ``limit`` ids.
    """
    page = (
        products.where(F.col("seller_id") == seller_id)
        .orderBy("name", "product_id")
        .offset(offset)
        .limit(limit)
    )
    ids = F.broadcast(page.select("product_id")) if limit <= 10_000 else page.select("product_id")
    newest = F.max_by(F.struct("price", "currency", "in_stock"), F.struct(*order)).alias("n")
    latest = (
        observations.join(ids, "product_id", "left_semi").groupBy("product_id").agg(newest)
    )
    return page.join(
        latest.select(
            "product_id", F.col("n.price").alias("latest_price"), "n.currency", "n.in_stock"
        ),
        "product_id",
        "left",
    )


def page_totals(products: DataFrame, page: int, per_page: int) -> DataFrame:
    """Per seller: total products and the range shown on page ``page``."""
    total = F.col("total")
    end = F.least(F.lit(page * per_page), total)
    return products.groupBy("seller_id").agg(F.count("product_id").alias("total")).select(
        "seller_id",
        "total",
        F.when(total == 0, 0).otherwise(F.lit((page - 1) * per_page + 1)).alias("range_start"),
        end.alias("range_end"),
        F.lit(page > 1).alias("has_prev"),
        (end < total).alias("has_next"),
    )


def filter_products(products: DataFrame, needle: str) -> DataFrame:
    """Products whose name, category or sku contains the text; blank text keeps all."""
    text = needle.strip().lower()
    if not text:
        return products
    fields = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "category", "sku")]
    hit = fields[0].contains(text)
    for field in fields[1:]:
        hit = hit | field.contains(text)
    return products.where(hit)


def sort_products(listing: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Listing by name, category, price or stock, with its ``position``; null price is lowest, null stock is False."""
    columns = {
        "name": F.collate("name", "UNICODE"),
        "category": F.collate("category", "UNICODE"),
        "price": F.col("latest_price"),
        "stock": F.coalesce("in_stock", F.lit(False)),
    }
    column = columns[key]
    primary = column.desc_nulls_last() if descending else column.asc_nulls_first()
    numbered = number_rows(listing, [], [primary, F.col("name"), F.col("product_id")], "position")
    return numbered.orderBy("position")


def resolve_seller(guesses: DataFrame, sellers: DataFrame) -> DataFrame:
    """Best seller for every distinct ``guess``: exact slug, else loose match, shortest slug.

    A loose match is a slug containing the slugged guess or a name containing
    the guess (both ignoring case, LIKE wildcards active), found by an index of
    pieces of text.
    """
    wanted = guesses.select("guess").distinct()
    slugs = sellers.select("seller_id", "slug", F.col("name").alias("seller_name"))
    prepared = wanted.withColumn("slugged", seller_slug_guess(F.col("guess")))
    exact = prepared.join(slugs, F.col("guess") == F.col("slug")).select(
        "guess", F.lit(0).alias("priority"), "seller_id", "slug"
    )
    near = _loose(prepared, slugs).select("guess", F.lit(1).alias("priority"), "seller_id", "slug")
    best = F.min(F.struct("priority", F.length("slug").alias("size"), "slug", "seller_id"))
    return (
        exact.unionByName(near)
        .groupBy("guess")
        .agg(best.alias("best"))
        .select("guess", F.col("best.slug").alias("slug"), F.col("best.seller_id").alias("seller_id"))
    )


def _pieces(text: Column, size: int) -> Column:
    last = F.greatest(F.length(text) - (size - 1), F.lit(1))
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))
    )


def _loose(prepared: DataFrame, slugs: DataFrame) -> DataFrame:
    """The loose match by an index of the texts' pieces of one to three letters.

    The index holds each distinct piece once, with the number of its texts and the
    best seller among them. A guess of up to three letters is answered by its own
    entry, and one of nothing but wildcards by the best seller per least length.
    Any other guess joins on the rarest of the pieces that a match must hold: of
    three letters where there are three in a row, else of two. Only letters that
    all stand alone between wildcards leave a single one.
    """
    best = F.min(F.struct(F.length("slug").alias("size"), "slug", "seller_id")).alias("best")
    parts = []
    for pattern, text in (("slugged", "slug"), ("guess", "seller_name")):
        lowered = F.lower(text)
        pieces = F.array_union(F.array_union(_pieces(lowered, 1), _pieces(lowered, 2)), _pieces(lowered, 3))
        postings = slugs.select("seller_id", "slug", F.col(text).alias("text"), F.explode(pieces).alias("piece"))
        index = postings.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), best)
        asked = prepared.select(
            "guess",
            F.col(pattern).alias("pattern"),
            F.regexp_replace(F.lower(pattern), "^%+|%+$", "").alias("core"),  # at an end '%' changes nothing
        )
        short = F.col("core").rlike(r"^[^%_\\]{1,3}$")
        blank = F.col("core").rlike("^[%_]*$")
        parts.append(asked.where(short).join(index, F.col("core") == F.col("piece")).select("guess", "best"))

        by_length = slugs.groupBy(F.length(lowered).alias("size")).agg(best)
        at_least = (
            by_length.select(F.explode(F.sequence(F.lit(0), "size")).alias("least"), "best")
            .groupBy("least")
            .agg(F.min("best").alias("best"))
        )
        least = F.length(F.replace("core", F.lit("%"), F.lit("")))
        parts.append(asked.where(blank).join(at_least, least == F.col("least")).select("guess", "best"))

        needed = asked.where(~short & ~blank).select("guess", "pattern", F.explode(_needed("core")).alias("piece"))
        counted = needed.join(index.select("piece", "n"), "piece", "left").fillna(0, subset=["n"])
        rarest = counted.groupBy("guess", "pattern").agg(
            F.min("n").alias("n"), F.min_by("piece", F.struct("n", "piece")).alias("piece")
        )
        found = rarest.where("n > 0").join(postings, "piece").where("text ILIKE concat('%', pattern, '%')")
        parts.append(found.groupBy("guess").agg(best))
    near = parts[0]
    for part in parts[1:]:
        near = near.unionByName(part)
    return near.select("guess", "best.seller_id", "best.slug")


def _needed(core: str) -> Column:
    """Pieces that every match of a pattern holds; an escaped character where there is no other."""

    def runs(pattern: str) -> Column:
        return F.regexp_extract_all(core, F.lit(pattern), F.lit(1))

    three, two, one = runs(r"([^%_\\]{3,})"), runs(r"([^%_\\]{2})"), runs(r"([^%_\\])")
    trigrams = F.flatten(F.transform(three, lambda run: _pieces(run, 3)))
    return F.array_distinct(
        F.when(F.size(three) > 0, trigrams)
        .when(F.size(two) > 0, two)
        .when(F.size(one) > 0, one)
        .otherwise(runs(r"\\(.)"))
    )


def rows_by_guess(guesses: DataFrame, sellers: DataFrame, rows: DataFrame) -> DataFrame:
    """(guess, rows...) of the seller that every guess resolves to; an unknown seller gives none.

    ``rows`` has ``seller_id``. One row a guess meets the rows, so AQE can split a hot seller.
    """
    resolved = resolve_seller(guesses, sellers).select("guess", "seller_id")
    return resolved.join(rows, "seller_id")


def prepare_swot(submitted: DataFrame, model: str, generated_at: Column) -> DataFrame:
    """Submitted analyses ready to append: four text lists, the model and the time.

    History is append-only: an analysis never replaces an earlier one.
    """
    lists = ["strengths", "weaknesses", "opportunities", "threats"]
    return submitted.select(
        "seller_id",
        *[F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in lists],
        generated_at.alias("generated_at"),
        F.lit(model).alias("model_used"),
        "source_summary",
    )


def swot_latest(swot: DataFrame) -> DataFrame:
    newest = [F.col("generated_at").desc(), F.col("swot_id").desc()]
    return top_n(swot, ["seller_id"], newest, 1).drop("rank_no")


def swot_history(swot: DataFrame, seller_id: int | None = None) -> DataFrame:
    """Analyses of one or all sellers; ``position`` counts from the newest."""
    chosen = swot if seller_id is None else swot.where(F.col("seller_id") == seller_id)
    newest = [F.col("generated_at").desc(), F.col("swot_id").desc()]
    return number_rows(chosen, [], newest, "position")

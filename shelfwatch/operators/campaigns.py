"""Promotions and news: search, feeds, deduplicated append and the activity timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.ranking import number_rows, top_n
from ..functions.text import contains_ignoring_case, embedding_text

CAMPAIGN_KEY = ["seller_id", "product_id", "discount_text"]


def _newest_first():
    return [F.col("discovered_at").desc(), F.col("campaign_id").desc()]


def search_campaigns(
    campaigns: DataFrame,
    products: DataFrame | None = None,
    product_query: str = "",
    limit: int = K.CAMPAIGN_SEARCH_LIMIT,
) -> DataFrame:
    """Newest ``limit`` promotions of every seller.

    With a product query only promotions tied to a matching product remain;
    without one, sitewide promotions are listed too. Promotions that go with a
    ``guess`` (see ``sellers.rows_by_guess``) are ranked under each guess.
    """
    if product_query:
        matching = products.where(
            F.col("name").isNotNull() & contains_ignoring_case(F.col("name"), product_query)
        )
        campaigns = campaigns.join(matching.select("product_id"), "product_id", "left_semi")
    by = ["guess", "seller_id"] if "guess" in campaigns.columns else ["seller_id"]
    return top_n(campaigns, by, _newest_first(), limit)


def campaigns_of(
    campaigns: DataFrame, seller_id: int | None = None, product_id: int | None = None
) -> DataFrame:
    """All promotions of a seller or a product; ``position`` counts from the newest."""
    if seller_id is not None:
        campaigns = campaigns.where(F.col("seller_id") == seller_id)
    if product_id is not None:
        campaigns = campaigns.where(F.col("product_id") == product_id)
    return number_rows(campaigns, [], _newest_first(), "position")


def campaign_lines(campaigns: DataFrame) -> DataFrame:
    """One readable line per promotion, with its date window when any side is known."""

    def side(column: str):
        return F.coalesce(F.date_format(column, "yyyy-MM-dd"), F.lit("?"))

    window = F.when(
        F.col("starts_at").isNotNull() | F.col("ends_at").isNotNull(),
        F.concat(F.lit(" ("), side("starts_at"), F.lit(" to "), side("ends_at"), F.lit(")")),
    ).otherwise(F.lit(""))
    line = F.concat(
        "title", F.lit(" — "), "discount_text", window, F.lit(": "), "description"
    )
    return campaigns.select("campaign_id", line.alias("line"))


def new_campaigns(detected: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Detected promotions to append: first per key, and the key not recorded yet.

    The key is (seller, product or sitewide, discount text); the title is left
    out on purpose, because wording varies while the offer does not.
    """
    known = existing.select(*CAMPAIGN_KEY).distinct()
    columns = [c for c in detected.columns if c not in CAMPAIGN_KEY]
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("first")
    candidates = detected.groupBy(*CAMPAIGN_KEY).agg(first).select(*CAMPAIGN_KEY, "first.*")
    a, b = candidates.alias("a"), known.alias("b")
    same = (
        (F.col("a.seller_id") == F.col("b.seller_id"))
        & F.col("a.product_id").eqNullSafe(F.col("b.product_id"))
        & (F.col("a.discount_text") == F.col("b.discount_text"))
    )
    return a.join(b, same, "left_anti").select("a.*")


def developments_feed(developments: DataFrame, seller_id: int | None = None) -> DataFrame:
    """News of one or all sellers; ``position`` counts from the newest."""
    if seller_id is not None:
        developments = developments.where(F.col("seller_id") == seller_id)
    newest = [F.col("event_date").desc(), F.col("development_id").desc()]
    return number_rows(developments, [], newest, "position")


def development_lines(developments: DataFrame) -> DataFrame:
    """One readable line per development: category, title, day and summary."""
    day = F.date_format("event_date", "yyyy-MM-dd")
    line = F.concat(
        F.lit("["), "category", F.lit("] "), "title", F.lit(" ("), day, F.lit("): "), "summary"
    )
    return developments.select("development_id", line.alias("line"))


def prepare_developments(submitted: DataFrame) -> DataFrame:
    """Submitted news ready to append: ISO dates parsed, text for the embedding model added."""
    return submitted.withColumn(
        "event_date", F.to_timestamp_ntz(F.col("event_date"))
    ).withColumn("embedding_text", embedding_text(F.col("title"), F.col("summary")))


def prepare_campaigns(submitted: DataFrame) -> DataFrame:
    """Manually submitted promotions: ISO dates parsed, blanks become null."""
    for column in ("starts_at", "ends_at"):
        submitted = submitted.withColumn(
            column, F.to_timestamp_ntz(F.nullif(F.col(column), F.lit("")))
        )
    return submitted


def recent_activity(
    campaigns: DataFrame, developments: DataFrame, sellers: DataFrame, limit: int = K.ACTIVITY_LIMIT
) -> DataFrame:
    """Newest promotions and news of all sellers as one timeline.

    Each side is cut to the newest ``limit`` before the union, so nothing large
    is sorted.
    """
    promos = campaigns.select(
        F.lit("campaign").alias("kind"),
        F.col("campaign_id").alias("id"),
        "seller_id",
        "title",
        F.col("description").alias("detail"),
        F.col("discovered_at").alias("at"),
        "discount_text",
    )
    news = developments.select(
        F.lit("development").alias("kind"),
        F.col("development_id").alias("id"),
        "seller_id",
        "title",
        F.col("summary").alias("detail"),
        F.col("discovered_at").alias("at"),
        "category",
    )
    newest = [F.col("at").desc(), F.col("kind"), F.col("id").desc()]
    tracked = sellers.select(
        "seller_id", F.col("slug").alias("seller_slug"), F.col("name").alias("seller_name")
    )
    sides = [
        side.join(tracked, "seller_id").orderBy(*newest).limit(limit) for side in (promos, news)
    ]
    return (
        sides[0].unionByName(sides[1], allowMissingColumns=True).orderBy(*newest).limit(limit)
    )

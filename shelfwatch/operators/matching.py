"""Match scraped items to products and create the missing ones.

Items carry ``seller_id, sku, name, category, url`` and the columns of a total
``order`` (page and position). Products carry ``product_id, seller_id, sku,
name, category, url``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.prices import promo_text
from ..functions.text import blank_to_null
from ..session import materialise
from .feed_import import PRODUCT_KEY
from .ids import assign_ids

_BY_SKU = ["seller_id", "sku"]
_BY_NAME = ["seller_id", "name"]


def _existing_ids(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items with ``id_by_sku`` and ``id_by_name``; duplicate keys give the lowest id.

    ``lacks_sku`` tells whether the product found by name has no sku yet.
    Items without a sku skip the sku join, so their null keys never gather in
    one task.
    """
    cleaned = items.withColumn("sku", blank_to_null(F.col("sku")))
    sku_ids = (
        products.where(F.col("sku").isNotNull())
        .groupBy(*_BY_SKU)
        .agg(F.min("product_id").alias("id_by_sku"))
    )
    no_sku = blank_to_null(F.col("sku")).isNull()
    name_ids = products.groupBy(*_BY_NAME).agg(
        F.min("product_id").alias("id_by_name"), F.min_by(no_sku, "product_id").alias("lacks_sku")
    )
    return _join_skus(cleaned, sku_ids).join(name_ids, _BY_NAME, "left")


def _join_skus(items: DataFrame, by_sku: DataFrame) -> DataFrame:
    """Left join on (seller, sku) of the items that have a sku."""
    with_sku = items.where(F.col("sku").isNotNull()).join(by_sku, _BY_SKU, "left")
    return with_sku.unionByName(items.where(F.col("sku").isNull()), allowMissingColumns=True)


def match_products(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items with the ``product_id`` they match, or null.

    A non-empty sku is tried first; only when it finds nothing is the name tried.
    """
    return _existing_ids(items, products).withColumn(
        "product_id", F.coalesce("id_by_sku", "id_by_name")
    ).drop("id_by_sku", "id_by_name", "lacks_sku")


def founders(known: DataFrame, order: list[str]) -> DataFrame:
    """The items that found a new product or give one its missing sku, processing items in ``order``.

    An item founds a product unless an earlier one of the same seller holds its
    sku or its name. An item that goes by name to a product without a sku fills
    that sku (``fills``, with ``id_by_name`` if the product was known before) and
    holds it from then on. Each round settles every item that is first for both
    its sku and its name, then drops all items these answer for; a product
    founded without a sku leaves the items of its name that have one. The number
    of rounds is the longest chain of such dependencies, usually two or three,
    and only distinct (seller, sku, name) keys take part.
    """
    acting = F.col("id_by_name").isNull() | (F.col("lacks_sku") & F.col("sku").isNotNull())
    remaining = known.where(F.col("id_by_sku").isNull() & acting).groupBy("seller_id", "sku", "name").agg(
        F.min(F.struct(*order)).alias("first_at"),
        F.min("id_by_name").alias("id_by_name"),
        F.min("id_by_name").isNotNull().alias("fills"),
    )
    remaining = materialise(remaining, "unmatched-keys")
    settled = None
    while not remaining.isEmpty():
        first_of_name = remaining.groupBy(*_BY_NAME).agg(F.min("first_at").alias("name_first"))
        first_of_sku = (
            remaining.where(F.col("sku").isNotNull())
            .groupBy(*_BY_SKU)
            .agg(F.min("first_at").alias("sku_first"))
        )
        leading = remaining.join(first_of_name, _BY_NAME).where("first_at = name_first")
        with_sku = (
            leading.where(F.col("sku").isNotNull())
            .join(first_of_sku, _BY_SKU)
            .where("first_at = sku_first")
        )
        columns = ["seller_id", "sku", "name", "first_at", "id_by_name", "fills"]
        new = with_sku.select(*columns).unionByName(
            leading.where(F.col("sku").isNull()).select(*columns)
        )
        new = materialise(new, "founders")
        settled = new if settled is None else settled.unionByName(new)
        done = new.where(F.col("sku").isNotNull())
        without = new.where(F.col("sku").isNull()).select(*_BY_NAME, F.lit(True).alias("founded"))
        left = (
            remaining.join(done.select(*_BY_NAME), _BY_NAME, "left_anti")
            .join(without, _BY_NAME, "left")
            .withColumn("fills", F.col("fills") | F.col("founded").isNotNull())
            .select(*columns)
        )
        unanswered = left.where(F.col("sku").isNotNull()).join(
            done.select(*_BY_SKU), _BY_SKU, "left_anti"
        )
        without_sku = left.where(F.col("sku").isNull() & ~F.col("fills"))
        remaining = materialise(unanswered.unionByName(without_sku), "unmatched-keys")
    return settled if settled is not None else remaining


def _place(known: DataFrame, created: DataFrame, fills: DataFrame, order: list[str]) -> DataFrame:
    """The product of every item, as of its turn.

    A product created in this batch counts only from its founder on, and a sku
    filled in this batch from the item that filled it, so an item may go by name
    although a later item founds a product with its sku.
    """
    created_ids = created.select(*_BY_NAME, "product_id")
    filled = fills.join(created_ids, _BY_NAME, "left").withColumn(
        "product_id", F.coalesce("id_by_name", "product_id")
    )
    columns = [*_BY_SKU, "product_id", "first_at"]
    holders = created.where(F.col("sku").isNotNull()).select(*columns).unionByName(filled.select(*columns))
    sku_founders = holders.select(
        *_BY_SKU, F.col("product_id").alias("new_by_sku"), F.col("first_at").alias("sku_from")
    )
    name_founders = created.select(
        *_BY_NAME, F.col("product_id").alias("new_by_name"), F.col("first_at").alias("name_from")
    )
    at = F.struct(*order)
    return (
        _join_skus(known, sku_founders)
        .join(name_founders, _BY_NAME, "left")
        .withColumn(
            "product_id",
            F.coalesce(
                "id_by_sku",
                F.when(F.col("sku_from") <= at, F.col("new_by_sku")),
                "id_by_name",
                F.when(F.col("name_from") <= at, F.col("new_by_name")),
            ),
        )
        .drop("id_by_sku", "id_by_name", "lacks_sku", "new_by_sku", "new_by_name", "sku_from", "name_from")
    )


def find_or_create(
    items: DataFrame, products: DataFrame, order: list[str], seen_at: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(items with product ids, the whole product table after the batch).

    Existing rows keep their name; category and url follow the last item that
    states them, and a missing sku is filled by the first item that has one;
    later items with that sku are the same product.
    Other product columns stay. With ``seen_at``, a time column of the items,
    ``last_seen_at`` moves on with every match and new products get both times.
    ``seen`` tells whether an item of the batch is the product.
    """
    known = _existing_ids(items, products)
    settled = founders(known, order)
    founded = settled.where(~F.col("fills")).drop("id_by_name", "fills")
    created = assign_ids(founded, products, "product_id", PRODUCT_KEY)
    placed = _place(known, created, settled.where("fills"), order)

    at = F.struct(*order)
    stated_category = blank_to_null(F.col("category"))
    stated_url = blank_to_null(F.col("url"))
    news = placed.groupBy("product_id").agg(
        F.max_by(stated_category, F.when(stated_category.isNotNull(), at)).alias("new_category"),
        F.max_by(stated_url, F.when(stated_url.isNotNull(), at)).alias("new_url"),
        F.min_by("sku", F.when(F.col("sku").isNotNull(), at)).alias("new_sku"),
        F.lit(True).alias("was_seen"),
        *[f(seen_at).alias(n) for f, n in ((F.min, "from_time"), (F.max, "to_time")) if seen_at],
    )
    blank = created.select(
        "product_id", "seller_id", "sku", "name", F.lit("").alias("category"), F.lit("").alias("url")
    ).withColumn("is_new", F.lit(True))
    own = ("product_id", "seller_id", "sku", "name", "category", "url")
    times = {"first_seen_at": F.coalesce("first_seen_at", "from_time"),
             "last_seen_at": F.greatest("last_seen_at", "to_time")} if seen_at else {}
    kept = [times.get(c, F.col(c)).alias(c) for c in products.columns if c not in own]
    after = (
        products.withColumn("is_new", F.lit(False))
        .unionByName(blank, allowMissingColumns=True)
        .join(news, "product_id", "left")
        .select(
            "product_id",
            "seller_id",
            F.coalesce(blank_to_null(F.col("sku")), "new_sku").alias("sku"),
            "name",
            F.coalesce("new_category", "category").alias("category"),
            F.coalesce("new_url", "url").alias("url"),
            *kept,
            "is_new",
            F.coalesce("was_seen", F.lit(False)).alias("seen"),
        )
    )
    return placed, after


def sku_conflicts(placed: DataFrame) -> DataFrame:
    """Skus of one seller that ended up on more than one product, for review.

    This can only happen when an item went by name to a product that has another
    sku, before an item of another name founded or filled a product with its sku.
    """
    return (
        placed.where(F.col("sku").isNotNull())
        .groupBy(*_BY_SKU)
        .agg(
            F.min("product_id").alias("first_product_id"),
            F.max("product_id").alias("last_product_id"),
        )
        .where("first_product_id <> last_product_id")
    )


def crawl_observations(placed: DataFrame) -> DataFrame:
    """Price observations of placed items, markdowns noted in the promo text."""
    promo = promo_text(
        F.col("promo_text"), F.col("currency"), F.col("original_price"), F.col("price")
    )
    return placed.select(
        "product_id",
        F.col("price").cast("decimal(10,2)").alias("price"),
        "currency",
        "in_stock",
        promo.alias("promo_text"),
        "observed_at",
        F.lit(K.CRAWL_SOURCE).alias("source"),
    )

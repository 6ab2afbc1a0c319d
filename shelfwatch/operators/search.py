"""Ranked product search and comparable products.

A query matches a product when they share a keyword, compared by English word
stem with stop words left out. The rank is the sum of the weights of the shared
keywords (a keyword found n times weighs 1 + 1/4 + ... + 1/n², scaled) divided
by the number of distinct query keywords.

Exact top-k without pairing every two products that share a common word: each
name files its best candidates under every subset of its keywords, and a query
looks up every subset of its own. Under the subset that is exactly what query
and candidate share, anything ranked before the candidate also beats it for
the query, so 2k entries per subset (k per seller) are enough for any k results
that leave out one seller. Names with more than ``MAX_SUBSET_TERMS`` distinct
keywords would have too many subsets; pairs with such a name on either side are
found through a plain keyword join, which is just as exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import text as X
from ..functions.ranking import top_n
from ..functions.stemming import english_stems
from ..session import materialise

MAX_SUBSET_TERMS = 10
# Ranks are added up as whole numbers in this unit, so sums do not depend on order.
_UNIT = 1_000_000_000


def _term_weight(times: Column) -> Column:
    harmonic = F.aggregate(
        F.sequence(F.lit(1), times),
        F.lit(0.0),
        lambda acc, j: acc + F.lit(1.0) / (j * j).cast("double"),
    )
    scaled = harmonic * F.lit(K.RANK_TERM_WEIGHT / K.RANK_NORMALISER * _UNIT)
    return F.round(scaled).cast("bigint")


def weighted_terms(texts: DataFrame) -> DataFrame:
    """(text, terms) of the distinct texts of ``texts`` (text): their word stems, sorted, with weights.

    The words' stems come from one dictionary of all distinct words.
    """
    words = texts.distinct().select("text", F.explode(X.keywords(F.col("text"))).alias("word"))
    counted = words.join(english_stems(words), "word").groupBy("text", "stem").agg(F.count(F.lit(1)).alias("times"))
    term = F.struct(F.col("stem").alias("term"), _term_weight(F.col("times")).alias("weight"))
    return counted.groupBy("text").agg(F.array_sort(F.collect_list(term)).alias("terms"))


def _subsets(terms: Column) -> Column:
    """All non-empty subsets of a sorted array as (key, score) structs."""
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(terms)) - 1)

    def pick(mask: Column) -> Column:
        chosen = F.filter(
            terms, lambda t, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1
        )
        key = F.array_join(F.transform(chosen, lambda t: t["term"]), " ")
        score = F.aggregate(chosen, F.lit(0).cast("bigint"), lambda acc, t: acc + t["weight"])
        return F.struct(key.alias("key"), score.alias("score"))

    return F.transform(masks, pick)


def _candidates(products: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """At most ``k`` products (lowest ids) per seller and name; equal names rank alike."""
    few = top_n(
        products.select("product_id", "seller_id", "name"),
        ["seller_id", "name"],
        [F.col("product_id")],
        k,
    )
    return few.withColumnRenamed("name", "text").join(terms, "text").select(
        "product_id", F.col("seller_id").alias("found_seller"), "terms"
    )


def rank_matches(queries: DataFrame, products: DataFrame, k: int) -> DataFrame:
    """Best ``k`` products of every query.

    ``queries``: query_key, text, own_seller (left out of the results; null
    leaves out nobody). A query without keywords has no results. Gives
    query_key, product_id, rank and rank_no.
    """
    texts = queries.select("text").unionByName(products.select(F.col("name").alias("text")))
    terms = materialise(weighted_terms(texts), "name-terms")  # used on both sides, long and short
    wanted = queries.join(terms, "text").select("query_key", "own_seller", "terms")
    candidates = _candidates(products, terms, k)
    long_name = F.size("terms") > MAX_SUBSET_TERMS

    filed = candidates.where(~long_name).select(
        "product_id", "found_seller", F.inline(_subsets(F.col("terms")))
    )
    best_first = [F.col("score").desc(), F.col("product_id")]
    per_seller = top_n(filed, ["key", "found_seller"], best_first, k).drop("rank_no")
    shelves = top_n(per_seller, ["key"], best_first, 2 * k).drop("rank_no")

    size = F.size("terms").alias("query_size")
    lookups = wanted.where(~long_name).select(
        "query_key", "own_seller", size, F.inline(_subsets(F.col("terms")))
    ).drop("score")
    by_subset = lookups.join(shelves, "key").select(
        "query_key", "own_seller", "query_size", "product_id", "found_seller", "score"
    )

    by_term = _long_matches(wanted, candidates, long_name, size)
    others = F.col("own_seller").isNull() | (F.col("own_seller") != F.col("found_seller"))
    scored = (
        by_subset.unionByName(by_term)
        .where(others)
        .groupBy("query_key", "query_size", "product_id")
        .agg(F.max("score").alias("score"))
    )
    ranked = top_n(scored, ["query_key"], best_first, k)
    rank = F.round(F.col("score") / F.lit(float(_UNIT)) / F.col("query_size"), 6)
    return ranked.select("query_key", "product_id", rank.alias("rank"), "rank_no")


def _long_matches(
    wanted: DataFrame, candidates: DataFrame, long_name: Column, size: Column
) -> DataFrame:
    """Scores of pairs where the query or the product has a long name."""
    asked = wanted.select("query_key", "own_seller", size, long_name.alias("long_query"), F.inline("terms"))
    asked = asked.drop("weight")
    posted = candidates.select(
        "product_id", "found_seller", long_name.alias("long_product"), F.inline("terms")
    )
    every = asked.where("long_query").join(posted, "term")
    rest = asked.where("NOT long_query").join(posted.where("long_product"), "term")
    columns = ["query_key", "own_seller", "query_size", "product_id", "found_seller"]
    pairs = every.select(*columns, "weight").unionByName(rest.select(*columns, "weight"))
    return pairs.groupBy(*columns).agg(F.sum("weight").alias("score"))


def search_products(
    queries: DataFrame, products: DataFrame, sellers: DataFrame, latest: DataFrame,
    limit: int = K.DEFAULT_SEARCH_LIMIT,
) -> DataFrame:
    """Search results of many queries (query_id, text) over all sellers."""
    asked = queries.select(F.col("text").alias("query_key"), "text").distinct()
    asked = asked.withColumn("own_seller", F.lit(None).cast("bigint"))
    hits = rank_matches(asked, products, limit).withColumnRenamed("query_key", "text")
    return _described(queries.join(hits, "text"), products, sellers, latest)


def comparable_products(
    products: DataFrame, sellers: DataFrame, latest: DataFrame,
    limit: int = K.DEFAULT_COMPARABLE_LIMIT,
) -> DataFrame:
    """For every product, the most similar product names of other sellers.

    Products of one seller with one name share their results, so the ranking
    runs once per (seller, name) and is joined back at the end.
    """
    key = F.concat_ws("\x1f", F.col("seller_id").cast("string"), "name")
    keyed = products.withColumn("query_key", key)
    asked = keyed.select(
        "query_key", F.col("name").alias("text"), F.col("seller_id").cast("bigint").alias("own_seller")
    ).distinct()
    hits = rank_matches(asked, products, limit)
    subjects = keyed.select(F.col("product_id").alias("subject_id"), "query_key")
    return _described(subjects.join(hits, "query_key").drop("query_key"), products, sellers, latest)


def _described(
    hits: DataFrame, products: DataFrame, sellers: DataFrame, latest: DataFrame
) -> DataFrame:
    """Result columns: name, url, seller and latest price of each found product."""
    found = products.select("product_id", "name", "url", "seller_id")
    shown = sellers.select(
        "seller_id", F.col("slug").alias("seller_slug"), F.col("name").alias("seller_name")
    )
    price = latest.select("product_id", F.col("price").alias("latest_price"), "currency")
    return (
        hits.join(found, "product_id").join(shown, "seller_id").join(price, "product_id", "left")
    )


def latest_of(hits: DataFrame, observations: DataFrame, order: list[str]) -> DataFrame:
    """Latest observation of the found products only."""
    ids = hits.select("product_id").distinct()
    newest = F.max_by(F.struct("price", "currency"), F.struct(*order)).alias("newest")
    return (
        observations.join(ids, "product_id", "left_semi")
        .groupBy("product_id")
        .agg(newest)
        .select("product_id", "newest.*")
    )

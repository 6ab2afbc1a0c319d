"""Registered search and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import prices, search as S, vectors as V
from .tables import OBSERVATION_ORDER, oracle, portable, table, view


def name_keywords(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    words = F.array_join(X.keywords(F.col("text")), " ")
    return turns.select("conv_id", "turn", words.alias("keywords"))


def _latest(spark, sf_dir):
    return prices.latest_price(view(spark, sf_dir, "observations"), OBSERVATION_ORDER)


def comparable_products(spark, sf_dir):
    found = S.comparable_products(
        view(spark, sf_dir, "products"), view(spark, sf_dir, "sellers"), _latest(spark, sf_dir)
    )
    return portable(found)


_QUERIES = """
    SELECT DISTINCT p_type || ' ' || p_name || ' for the ' || substr(p_name, 1, 3) AS text FROM {part}
    UNION ALL SELECT 'the of in on' UNION ALL SELECT 'red red widget widget'"""


def search_products(spark, sf_dir):
    queries = spark.sql(_QUERIES, part=table(spark, sf_dir, "part"))
    found = S.search_products(
        queries, view(spark, sf_dir, "products"), view(spark, sf_dir, "sellers"),
        _latest(spark, sf_dir),
    )
    return portable(found)


def vector_topk(spark, sf_dir):
    """Nearest news for each seller, asked with the seller's first embedding."""
    items = view(spark, sf_dir, "developments").select("development_id", "seller_id", "embedding")
    queries = items.groupBy("seller_id").agg(
        F.min("development_id").alias("query_id"),
        F.min_by("embedding", "development_id").alias("embedding"),
    )
    found = V.nearest(items, queries, 5)
    return found.withColumn("distance", F.round("distance", 6))


def vector_topk_hundredths(spark, sf_dir):
    """Nearest news of the same seller for every row whose id is divisible by 100."""
    items = view(spark, sf_dir, "developments").select("development_id", "seller_id", "embedding")
    queries = items.where("development_id % 100 = 0").withColumnRenamed("development_id", "query_id")
    found = V.nearest(items, queries, 5)
    return found.withColumn("distance", F.round("distance", 6))


QUERIES = {
    f.__name__: f
    for f in (name_keywords, comparable_products, search_products, vector_topk, vector_topk_hundredths)
}

_STOP = "'the','and','of','for','with','our','your','in','on','is','are'"
_WEIGHT = "CAST(round(1e9 * 0.1 / 1.64493406685 * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j)))) AS BIGINT)"


def _terms(name, source, key):
    """Keyword counts of a text column, one row per (key, term)."""
    return f"""
        SELECT {key}, term, count(*) AS tf FROM (
            SELECT {key}, unnest(regexp_extract_all(lower({name}), '[a-z0-9]+')) AS term FROM {source})
        WHERE length(term) > 2 AND term NOT IN ({_STOP}) GROUP BY ALL"""


_LATEST = f"""
    latest AS (SELECT product_id, CAST(price AS DOUBLE) AS latest_price, currency FROM observations
               QUALIFY row_number() OVER (PARTITION BY product_id
                   ORDER BY {", ".join(c + " DESC" for c in OBSERVATION_ORDER)}) = 1),
    names AS (SELECT DISTINCT name FROM products),
    name_terms AS ({_terms("name", "names", "name")}),
    weighted AS (SELECT name, term, {_WEIGHT} AS weight FROM name_terms)"""

ORACLES = {
    "name_keywords": f"""
        SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'),
            lambda w: length(w) > 2 AND w NOT IN ({_STOP})), ' ') AS keywords FROM conversations""",
    "comparable_products": oracle(
        ["products", "sellers", "observations"],
        f"""WITH {_LATEST},
            scores AS (SELECT a.name AS asked, w.name, sum(w.weight) AS score
                       FROM name_terms a JOIN weighted w USING (term) GROUP BY ALL),
            sizes AS (SELECT name AS asked, count(*) AS size FROM name_terms GROUP BY ALL),
            groups AS (SELECT DISTINCT seller_id AS own, name AS asked FROM products),
            hits AS (
                SELECT g.own, g.asked, p.product_id, round(s.score / 1e9 / z.size, 6) AS rank,
                       row_number() OVER (PARTITION BY g.own, g.asked
                           ORDER BY s.score DESC, p.product_id) AS rank_no
                FROM groups g JOIN scores s USING (asked) JOIN sizes z USING (asked)
                JOIN products p ON p.name = s.name AND p.seller_id <> g.own
                QUALIFY rank_no <= 5)
            SELECT q.product_id AS subject_id, h.product_id, h.rank, h.rank_no, p.name, p.url, p.seller_id,
                   s.slug AS seller_slug, s.name AS seller_name, latest_price, currency
            FROM products q JOIN hits h ON h.own = q.seller_id AND h.asked = q.name
            JOIN products p ON p.product_id = h.product_id JOIN sellers s ON s.seller_id = p.seller_id
            LEFT JOIN latest l ON l.product_id = p.product_id""",
    ),
    "search_products": oracle(
        ["products", "sellers", "observations"],
        f"""WITH {_LATEST},
            queries AS ({_QUERIES.format(part="part")}),
            query_terms AS ({_terms("text", "queries", "text")}),
            scores AS (SELECT a.text, w.name, sum(w.weight) AS score
                       FROM query_terms a JOIN weighted w USING (term) GROUP BY ALL),
            sizes AS (SELECT text, count(*) AS size FROM query_terms GROUP BY ALL),
            hits AS (
                SELECT text, p.product_id, round(s.score / 1e9 / z.size, 6) AS rank,
                       row_number() OVER (PARTITION BY text ORDER BY s.score DESC, p.product_id) AS rank_no
                FROM scores s JOIN sizes z USING (text) JOIN products p USING (name)
                QUALIFY rank_no <= 20)
            SELECT h.text, h.product_id, h.rank, h.rank_no, p.name, p.url, p.seller_id,
                   s.slug AS seller_slug, s.name AS seller_name, latest_price, currency
            FROM hits h JOIN products p ON p.product_id = h.product_id
            JOIN sellers s ON s.seller_id = p.seller_id
            LEFT JOIN latest l ON l.product_id = p.product_id""",
    ),
    "vector_topk": oracle(
        ["developments"],
        """WITH queries AS (SELECT seller_id, min(development_id) AS query_id,
                                   arg_min(embedding, development_id) AS asked
                            FROM developments GROUP BY seller_id),
           d AS (SELECT query_id, development_id,
                        list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST(asked AS DOUBLE[])) AS distance
                 FROM developments JOIN queries USING (seller_id))
           SELECT query_id, development_id, round(distance, 6) AS distance,
                  row_number() OVER (PARTITION BY query_id ORDER BY distance, development_id) AS rank_no
           FROM d QUALIFY rank_no <= 5""",
    ),
    "vector_topk_hundredths": oracle(
        ["developments"],
        """WITH queries AS (SELECT seller_id, development_id AS query_id, embedding AS asked
                            FROM developments WHERE development_id % 100 = 0),
           d AS (SELECT query_id, development_id,
                        list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST(asked AS DOUBLE[])) AS distance
                 FROM developments JOIN queries USING (seller_id))
           SELECT query_id, development_id, round(distance, 6) AS distance,
                  row_number() OVER (PARTITION BY query_id ORDER BY distance, development_id) AS rank_no
           FROM d QUALIFY rank_no <= 5""",
    ),
}

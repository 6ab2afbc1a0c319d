"""Search against brute force, with long names and a hot keyword."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwatch import constants as K
from shelfwatch.functions.stemming import english_stems
from shelfwatch.operators import search as S, vectors as V


def stems_of(spark, words):
    table = spark.createDataFrame([(w,) for w in words], "word string")
    return {r.word: r.stem for r in english_stems(table).collect()}


def brute_force(queries, products, k, stems):
    def words(text):
        cleaned = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        kept = [w for w in cleaned if len(w) > 2 and w not in K.SEARCH_STOPWORDS]
        return [stems[w] for w in kept if w in stems]

    def weight(n):
        return round(1e9 * 0.1 / 1.64493406685 * sum(1 / j**2 for j in range(1, n + 1)))

    results = set()
    for key, text, own in queries:
        terms = set(words(text))
        scored = []
        for product, seller, name in products:
            found = words(name)
            score = sum(weight(found.count(t)) for t in terms if t in found)
            if score and seller != own:
                scored.append((-score, product))
        for number, (score, product) in enumerate(sorted(scored)[:k], 1):
            results.add((key, product, number, round(-score / 1e9 / len(terms), 6)))
    return results


@pytest.mark.parametrize("max_terms, seed", [(8, 1), (8, 2), (2, 3), (0, 4)])
def test_rank_matches_equals_brute_force(spark, monkeypatch, max_terms, seed):
    monkeypatch.setattr(S, "MAX_SUBSET_TERMS", max_terms)
    rng = random.Random(seed)
    vocabulary = ["rose", "roses", "tulip", "tulips", "lily", "lilies", "garden", "gardening"] + ["the", "hot", "own"]

    def name():
        picked = [rng.choice(vocabulary) for _ in range(rng.randint(1, 6))]
        return " ".join(picked + (["hot"] if rng.random() < 0.5 else []))

    products = [(i, 1 if rng.random() < 0.4 else rng.randint(1, 6), name()) for i in range(150)]
    queries = [(f"q{i}", name(), rng.choice([None, 1, 2, 3])) for i in range(40)] + [("none", "the of", None)]
    got = S.rank_matches(
        spark.createDataFrame(queries, "query_key string, text string, own_seller bigint"),
        spark.createDataFrame(products, "product_id bigint, seller_id bigint, name string"),
        4,
    )
    rows = {(r.query_key, r.product_id, r.rank_no, r["rank"]) for r in got.collect()}
    assert rows == brute_force(queries, products, 4, stems_of(spark, vocabulary))


def test_single_hit_rank_value(spark):
    got = S.rank_matches(
        spark.createDataFrame([("q", "tulip", None)], "query_key string, text string, own_seller bigint"),
        spark.createDataFrame([(1, 1, "Red Tulip")], "product_id bigint, seller_id bigint, name string"),
        5,
    ).first()
    assert got["rank"] == pytest.approx(0.060793, abs=1e-6)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "development_id bigint, seller_id bigint, embedding array<float>")


def brute_nearest(items, queries, k):
    found = set()
    for query, seller, asked in queries:
        scored = []
        for item, own, vector in items:
            if own == seller:
                a, b = np.array(asked, float), np.array(np.array(vector, "float32"), float)
                a = np.array(np.array(a, "float32"), float)
                size = np.linalg.norm(a) * np.linalg.norm(b)
                scored.append((round(1 - a @ b / size, 9) if size else 9.0, item))
        found |= {(query, item, n) for n, (_, item) in enumerate(sorted(scored)[:k], 1)}
    return found


@pytest.mark.parametrize("pivots, block, k", [(1, 4096, 5), (8, 7, 5), (40, 16, 31), (300, 3, 1)])
def test_nearest_equals_brute_force(spark, pivots, block, k):
    rng = random.Random(pivots)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    items = [(i, i % 3, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(200)]
    items += [(200 + i, 0, [0.0] * 6) for i in range(3)] + [(300 + i, 1, items[1][2]) for i in range(20)]
    items += [(400, 7, [1.0] * 6), (401, 7, [0.0] * 6)]
    queries = [(i, s, v) for i, s, v in items if i % 4 == 0 or i > 399] + [(1000, 2, [0.0] * 6), (1001, 99, [1.0] * 6)]
    asked = vectors(spark, queries).withColumnRenamed("development_id", "query_id")
    rows = V.nearest(vectors(spark, items).repartition(4), asked, k, pivots, block).collect()
    assert {(r.query_id, r.development_id, r.rank_no) for r in rows} == brute_nearest(items, queries, k)
    assert all(r.distance is None for r in rows if r.development_id in (200, 201, 202, 401) or r.query_id == 1000)


def test_far_balls_are_not_visited(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 32))
    items = [(i, 1, (centres[i % 20] + rng.normal(size=32) * 0.02).tolist()) for i in range(2000)]
    table = vectors(spark, items)
    placed = V._placed(table, V._centres(table, 60))
    balls = placed.groupBy("seller_id", "ball").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius"))
    asked = table.where("development_id % 10 = 0").withColumnRenamed("development_id", "query_id")
    visits = V._visits(asked, balls, V._centres(table, 60), 5)
    assert visits.join(balls, ["seller_id", "ball"]).agg(F.sum("n")).first()[0] < 0.15 * 200 * 2000


def test_tasks_send_k_rows_a_query(spark):
    rng = random.Random(8)
    rows = [(i, i % 3, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    items = vectors(spark, rows)
    queries = items.where("development_id % 4 = 0").withColumnRenamed("development_id", "query_id")
    plan = V.nearest(items, queries, 5)._jdf.queryExecution().executedPlan().toString()
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line]
    assert any("Partial" in line for line in limits) and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


def test_stems_of_published_samples(spark):
    pairs = """consignment consign consistency consist consolation consol consolatory consolatori
        consonant conson conspicuously conspicu conspiracy conspiraci constables constabl knackeries
        knackeri knavish knavish kneeling kneel knightly knight knitted knit knives knive generate generat
        general general generically generic ties tie cries cri gas gas this this kiwis kiwi gaps gap
        hoping hope hopping hop luxuriate luxuri relational relat sensational sensat hopefulness hope
        rational ration skies sky dying die inning inning perennials perenni lilies lili lily lili""".split()
    stems = stems_of(spark, pairs[::2])
    assert [stems.get(w, w) for w in pairs[::2]] == pairs[1::2]  # "this" is a stop word
    words = """y yes say sayyid flies cried die dies gas kiwis abilities feed agreed bleedly plastered sing hopping
        falling hoping filing trouble sized conflated conditionally digitizer vietnamization operator feudalism
        hopefulness apologi skilfully gently triplicate formalize electrical goodness formative revival allowance
        airliner adjustable defensible irritant replacement adoption homologous effective bowdlerize rate cease
        controll roll communism arsenal general inning earring cats bias boss""".split()
    want = """y yes say sayyid fli cri die die gas kiwi abil feed agre bleed plaster sing hop
        fall hope file troubl size conflat condit digit vietnam oper feudal
        hope apolog skil gentl triplic formal electr good format reviv allow
        airlin adjust defens irrit replac adopt homolog effect bowdler rate ceas
        control roll communism arsenal general inning earring cat bias boss""".split()
    stems = stems_of(spark, words)
    got = {w: (stems[w], v) for w, v in zip(words, want) if stems[w] != v}
    assert not got


def test_word_forms_match(spark):
    got = S.rank_matches(
        spark.createDataFrame([("q", "Tulips for gardens", None)], "query_key string, text string, own_seller bigint"),
        spark.createDataFrame(
            [(1, 1, "Tulip, garden"), (2, 1, "gardening rose"), (3, 1, "fern")],
            "product_id bigint, seller_id bigint, name string",
        ),
        5,
    )
    assert [(r.product_id, r.rank_no) for r in got.orderBy("rank_no").collect()] == [(1, 1), (2, 2)]

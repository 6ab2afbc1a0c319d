"""Feed import, matching, pagination, promotions and sinks against plain Python."""

import os
import random
import re
import time
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwatch import constants as K, schemas, session
from shelfwatch.functions.ranking import number_rows, top_n
from shelfwatch.functions.text import price_context
from shelfwatch.operators import campaigns as C, feed_import as I, matching as M, pagination as G, sellers as S
from shelfwatch.plans.tables import view
from shelfwatch.sources import feed, sinks

SELLERS = "seller_id bigint, slug string, name string, brand_num int"


@pytest.fixture()
def sellers(spark):
    return spark.createDataFrame([(1, "a", "A", 5), (2, "b", "B", 7), (3, "c", "C", None)], SELLERS)


def write(tmp_path, text):
    path = tmp_path / "feed.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


NO_PRODUCTS = "product_id bigint, seller_id bigint, sku string"
NO_OBSERVATIONS = "product_id bigint, observed_at timestamp_ntz, source string"


def test_feed_import_and_rerun(spark, sellers, tmp_path):
    path = write(
        tmp_path,
        'S1,5,bulb,"Tulip, ""red""",A,F25,10.00\n S1 ,5,other,Renamed,B,S26,12.00\n'
        "S1,7,bulb,Tulip of B,A,s27,NULL\nS1,5,bulb,again,A,F25,99.00\n",
    )
    parsed = feed.parse_feed(feed.read_feed(spark, path))
    products = spark.createDataFrame([], NO_PRODUCTS)
    stored = spark.createDataFrame([], NO_OBSERVATIONS)
    added, readings = I.import_feed(parsed, sellers, products, stored)
    names = {(r.seller_id, r.sku): r["name"] for r in added.collect()}
    assert names == {(1, "S1"): 'Tulip, "red"', (2, "S1"): "Tulip of B"}
    assert added.select("product_id").distinct().count() == 2
    rows = sorted(readings.collect(), key=lambda r: (r.product_id, r.observed_at))
    assert len(rows) == 3
    assert {(r.price, r.in_stock) for r in rows} == {
        (Decimal("10.00"), True), (Decimal("12.00"), True), (None, False)
    }
    assert {r.observed_at for r in rows} == {datetime(2025, 9, 1), datetime(2026, 3, 1), datetime(2027, 3, 1)}
    again, nothing = I.import_feed(parsed, sellers, added.select("product_id", "seller_id", "sku"), readings)
    assert again.isEmpty() and nothing.isEmpty()


@pytest.mark.parametrize("line", ["S1,5,b,n,g,X99,1.00", "S1,5,b,n,g,F25,ten", "S1,x,b,n,g,F25,1", "S1,5,b"])
def test_bad_rows_fail_or_are_rejected(spark, tmp_path, line):
    raw = feed.read_feed(spark, write(tmp_path, f"S0,5,b,n,g,F25,1.00\n{line}\n"))
    assert [r.sku for r in feed.rejects(raw).collect()] == ["S1"]
    assert [r.sku for r in feed.parse_feed(raw, strict=False).collect()] == ["S0"]
    with pytest.raises(Exception):
        feed.parse_feed(raw).collect()


def test_lines_with_a_wrong_number_of_fields(spark):
    good = "S0,5,b,n,g,F25,1.00"
    lines = spark.createDataFrame([(good,), (good.replace("S0", "S1") + ",8th",), ("S2,5,b",)], "line string")
    raw = feed.parse_lines(lines)
    assert sorted(r.sku for r in feed.rejects(raw).collect()) == ["S1", "S2"]
    assert [r.sku for r in feed.parse_feed(raw, strict=False).collect()] == ["S0"]
    with pytest.raises(Exception, match="bad feed row"):
        feed.parse_feed(raw).collect()


def test_new_sellers_get_ids(spark):
    known = spark.createDataFrame([(4, "a", "A", False, None)], "seller_id bigint, slug string, name string, is_own_brand boolean, brand_num int")
    own = spark.createDataFrame([("a", "other", 1), ("b", "B", 2), ("c", "C", 3)], "slug string, name string, brand_num int")
    after = {r.slug: r for r in S.upsert_own_brands(known, own).collect()}
    assert (after["a"].seller_id, after["a"]["name"], after["a"].brand_num) == (4, "A", 1)
    assert all(r.is_own_brand for r in after.values())
    assert len({r.seller_id for r in after.values()}) == 3 and min(after[s].seller_id for s in "bc") > 4
    registry = spark.createDataFrame([("a", "x", True), ("d", "D", True), ("e", "E", False)], "slug string, name string, active boolean")
    seeded = {r.slug: r.seller_id for r in S.seed_sellers(registry, known).collect()}
    assert seeded["a"] == 4 and seeded["d"] > 4 and set(seeded) == {"a", "d"}


def test_unknown_brand(spark, sellers, tmp_path):
    parsed = feed.parse_feed(feed.read_feed(spark, write(tmp_path, "S1,9,b,n,g,F25,1.00\n")))
    assert I.unknown_brands(parsed, sellers).count() == 1
    assert I.with_seller(parsed, sellers, strict=False).isEmpty()
    with pytest.raises(Exception, match="brand number"):
        I.with_seller(parsed, sellers).collect()


def test_feed_order_across_splits(spark, sellers, tmp_path):
    lines = "".join(f"S{i % 50},5,c,name {i},g,F25,{i}.00\n" for i in range(4000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        raw = feed.read_feed(spark, write(tmp_path, lines))
        assert raw.rdd.getNumPartitions() > 4
        placed = I.with_seller(feed.parse_feed(raw), sellers)
        fresh = I.new_products(placed, spark.createDataFrame([], NO_PRODUCTS), ["row_order"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.sku: r["name"] for r in fresh} == {f"S{i}": f"name {i}" for i in range(50)}


def test_observation_store_round_trip(spark, tmp_path):
    rows = [(1, Decimal("1.00"), datetime(2025, 1, 1), "internal_feed", 1),
            (1, Decimal("2.00"), datetime(2025, 1, 1), "internal_feed", 2),
            (1, Decimal("3.00"), datetime(2025, 1, 1), "scheduled_crawl", 3),
            (1, Decimal("3.00"), datetime(2025, 1, 1), "scheduled_crawl", 4)]
    schema = "product_id bigint, price decimal(10,2), observed_at timestamp_ntz, source string, n int"
    incoming = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "observations")
    first = sinks.new_observations(incoming, incoming.limit(0), ["n"])
    sinks.append_observations(first, path)
    stored = sinks.read_observations(spark, path)
    assert sorted(r.n for r in stored.collect()) == [1, 3, 4]
    second = sinks.new_observations(incoming, stored, ["n"])
    assert sorted(r.n for r in second.collect()) == [3, 4]  # crawled readings always append


# --- find or create ------------------------------------------------------------


def one_by_one(items, existing):
    """Process items in order, the way a single crawler would."""
    products = [dict(p) for p in existing]
    assigned = []
    for item in items:
        same = [p for p in products if p["seller"] == item["seller"]]
        found = None
        if item["sku"]:
            found = next((p for p in same if p["sku"] == item["sku"]), None)
        if found is None:
            found = next((p for p in same if p["name"] == item["name"]), None)
        if found is None:
            found = {"seller": item["seller"], "sku": item["sku"], "name": item["name"], "category": "", "url": "",
                     "id": f"new{len(products)}"}
            products.append(found)
        found["category"] = item["category"] or found["category"]
        found["url"] = item["url"] or found["url"]
        found["sku"] = found["sku"] or item["sku"]
        assigned.append(found["id"])
    return products, assigned


@pytest.mark.parametrize("seed", range(6))
def test_find_or_create_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    # Skus given to a product later (fill-ins) belong to one name, so chains of
    # shared skus and shared names stay, but no fill-in competes for a sku.
    def item(i):
        name = f"n{rng.randint(0, 9)}"
        sku = rng.choice([f"s{rng.randint(0, 9)}", f"own-{name}"]) if seed % 2 else f"s{rng.randint(0, 9)}"
        return {"seller": rng.randint(1, 2), "sku": sku, "name": name, "category": rng.choice(["", "c%d" % i]),
                "url": f"u{i}", "at": i}

    items = [item(i) for i in range(40)]
    existing, taken = [], set()
    for i in range(6):
        key = (rng.randint(1, 2), f"s{rng.randint(0, 9)}", f"n{rng.randint(0, 9)}")
        if not taken & {key[:2], (key[0], key[2])}:
            taken |= {key[:2], (key[0], key[2])}
            existing.append({"id": i, "seller": key[0], "sku": key[1], "name": key[2], "category": "", "url": ""})
    want, assigned = one_by_one(items, existing)

    items_df = spark.createDataFrame(
        [(x["seller"], x["sku"], x["name"], x["category"], x["url"], x["at"]) for x in items],
        "seller_id bigint, sku string, name string, category string, url string, at int",
    )
    products_df = spark.createDataFrame(
        [(x["id"], x["seller"], x["sku"], x["name"], x["category"], x["url"]) for x in existing],
        "product_id bigint, seller_id bigint, sku string, name string, category string, url string",
    )
    placed, after = M.find_or_create(items_df, products_df, ["at"])
    got = {(r.seller_id, r.sku, r["name"], r.category, r.url) for r in after.collect()}
    assert got == {(p["seller"], p["sku"], p["name"], p["category"], p["url"]) for p in want}
    pairs = {(r.product_id, a) for r, a in zip(sorted(placed.collect(), key=lambda r: r["at"]), assigned)}
    assert len({p for p, _ in pairs}) == len({a for _, a in pairs}) == len(pairs)


@pytest.mark.parametrize("seed", range(3))
def test_filled_skus_hold_for_later_items(spark, seed):
    rng = random.Random(seed)
    items = [
        {"seller": rng.randint(1, 2), "sku": rng.choice([None, *[f"s{k}" for k in range(9)]]),
         "name": f"n{rng.randint(0, 11)}", "category": "", "url": f"u{i}", "at": i}
        for i in range(60)
    ]
    items[:2] = [dict(items[0], seller=1, sku="s1", name="n1"), dict(items[1], seller=1, sku="s1", name="n2")]
    existing = [
        {"id": i, "seller": 1 + i % 2, "sku": None if i < 8 else f"s{i}", "name": f"n{i // 2 + 1}", "category": "", "url": ""}
        for i in range(0, 10)
    ]
    want, assigned = one_by_one(items, existing)
    items_df = spark.createDataFrame(
        [(x["seller"], x["sku"], x["name"], x["category"], x["url"], x["at"]) for x in items],
        "seller_id bigint, sku string, name string, category string, url string, at int",
    )
    products_df = spark.createDataFrame(
        [(x["id"], x["seller"], x["sku"], x["name"], x["category"], x["url"]) for x in existing],
        "product_id bigint, seller_id bigint, sku string, name string, category string, url string",
    )
    placed, after = M.find_or_create(items_df, products_df, ["at"])
    got = sorted(placed.select("at", "product_id").collect())
    assert got[0].product_id == got[1].product_id == 0
    key = lambda p: (p[0], p[1] or "", *p[2:])
    assert sorted([(r.seller_id, r.sku, r["name"], r.url) for r in after.collect()], key=key) == sorted(
        [(p["seller"], p["sku"], p["name"], p["url"]) for p in want], key=key
    )
    pairs = {(r.product_id, a) for r, a in zip(got, assigned)}
    assert len({p for p, _ in pairs}) == len({a for _, a in pairs}) == len(pairs)


def test_find_or_create_fills_missing_values(spark):
    schema = "seller_id bigint, sku string, name string, category string, url string, at int"
    items = spark.createDataFrame(
        [(1, None, "x", "", "u1", 1), (1, "S", "x", "cat", "u2", 2), (1, "", "x", "", "", 3)], schema
    )
    products = spark.createDataFrame(
        [(7, 2, None, "x", "old", "")],
        "product_id bigint, seller_id bigint, sku string, name string, category string, url string",
    )
    placed, after = M.find_or_create(items, products, ["at"])
    rows = {r.is_new: r for r in after.collect()}
    assert (rows[True].sku, rows[True].category, rows[True].url) == ("S", "cat", "u2")
    assert (rows[False].product_id, rows[False].category, rows[False].seen) == (7, "old", False)
    assert M.sku_conflicts(placed).isEmpty()


def test_find_or_create_gives_the_whole_table(spark):
    day = lambda d: datetime(2026, 1, d)
    items = spark.createDataFrame(
        [(1, "S", "x", "", "", 1, day(5)), (1, "S", "x", "", "", 2, day(7)), (1, None, "y", "", "", 3, day(6))],
        "seller_id bigint, sku string, name string, category string, url string, at int, seen timestamp_ntz",
    )
    products = spark.createDataFrame(
        [(7, 1, "S", "x", "fine", "c", "u", day(1), day(2)), (8, 1, "T", "z", "good", "c", "u", day(1), day(3))], schemas.PRODUCTS
    )
    _, after = M.find_or_create(items, products, ["at"], "seen")
    rows = {r["name"]: r for r in after.collect()}
    assert set(products.columns) <= set(after.columns)
    assert (rows["x"].grade, rows["x"].first_seen_at, rows["x"].last_seen_at, rows["x"].seen) == ("fine", day(1), day(7), True)
    assert (rows["z"].grade, rows["z"].last_seen_at, rows["z"].seen) == ("good", day(3), False)
    assert (rows["y"].first_seen_at, rows["y"].last_seen_at, rows["y"].is_new) == (day(6), day(6), True)


# --- pagination ------------------------------------------------------------------


def sequence(spark, pages):
    """pages: list of (url, next_url, text, names, links)."""
    page_rows = [("c", i, u, n, t) for i, (u, n, t, _, _) in enumerate(pages)]
    items = [("c", i, name) for i, p in enumerate(pages) for name in p[3]]
    links = [("c", i, link) for i, p in enumerate(pages) for link in p[4]]
    return G.pagination_stop(
        spark.createDataFrame(page_rows, "crawl string, page_idx int, url string, next_url string, context string"),
        spark.createDataFrame(items, "crawl string, page_idx int, name string"),
        spark.createDataFrame(links, "crawl string, page_idx int, url string"),
    ).orderBy("page_idx").collect()


@pytest.mark.parametrize(
    "pages, reasons, products",
    [
        ([("1", None, "only one", ["W"], [])], ["no_next_link"], [True]),
        ([("1", "2", "the same context", ["W"], []), ("2", "3", "the same context", ["X"], [])],
         [None, "recycled"], [True, False]),
        ([("1", "2", "one context", ["W"], []), ("2", "3", "another thing", ["W"], [])],
         [None, "nothing_new"], [True, False]),
        ([("1", "2", "one context", [], ["/a"]), ("2", None, "another thing", [], ["/b"])],
         [None, "no_next_link"], [True, True]),
        ([("1", "1", "one context", ["W"], []), ("1", None, "another thing", ["X"], [])],
         [None, "revisited"], [True, False]),
        ([("1", "2", "", ["W"], []), ("2", "3", "", ["X"], []), ("3", None, "", ["Y"], [])],
         [None, "recycled"], [True, False]),  # two pages without prices look alike
    ],
)
def test_where_pagination_stops(spark, pages, reasons, products):
    rows = sequence(spark, pages)
    assert [r.stop_reason for r in rows] == reasons
    assert [r.gives_products for r in rows] == products
    assert [r.gives_promotions for r in rows] == [r not in ("recycled", "revisited") for r in reasons]


def test_long_listings_are_followed_to_the_end(spark):
    pages = [(str(i), str(i + 1), f"{(i + 1) * 7919 * 104729:012d}" * 2, [f"n{i}"], []) for i in range(60)]
    rows = sequence(spark, pages)
    assert len(rows) == 60 and {r.stop_reason for r in rows} == {None}


def likeness(a, b):
    """Shared runs of eight characters over the mean number of runs."""
    x, y = ({t[i : i + 8] for i in range(max(len(t) - 7, 1))} if t else set() for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def test_every_piece_of_a_page_counts(spark):
    """Pages in crawls of one page, of some, and of so many that a crawl is many ranges."""
    rng, pages = random.Random(3), []
    for crawl, n in ((1, 1), (2, 7), (3, 600), (4, 0), (5, 3)):
        text = "".join(rng.choices("ab $", k=60))
        for i in range(n):
            text = "".join(c if rng.random() < 0.95 else rng.choice("ab $漢") for c in text)
            pages.append((crawl, 2 * i, rng.choice(["", text[:9], text, text, text, text])))
    pages.append((None, 1, "$"))
    df = spark.createDataFrame(pages, "crawl int, page_idx int, text string").repartition(8)
    context = df.select("*", price_context(F.col("text")).alias("context")).collect()
    contexts = {(r.crawl, r.page_idx): r.context for r in context}
    rows = G.recycled_pages(df).collect()
    assert len(rows) == len(pages) - 1  # a page of no crawl is none
    for r in rows:
        before = contexts.get((r.crawl, r.page_idx - 2))
        want = None if before is None else likeness(before, contexts[r.crawl, r.page_idx])
        assert r.similarity == (None if want is None else pytest.approx(want))
        assert r.is_recycled == (want is not None and want > 0.5)


def test_pages_less_than_half_alike_do_not_stop(spark):
    """Nine of nineteen runs are shared, but four of eight and seven least hashes of every four."""
    first, second = "now $099696082899394642459", "now $099696082892359550922"
    assert 0.4 < likeness(first, second) < 0.5
    rows = sequence(spark, [("1", "2", first, ["W"], []), ("2", None, second, ["X"], [])])
    assert [r.stop_reason for r in rows] == [None, "no_next_link"]


def test_a_limit_of_pages_is_the_callers(spark):
    pages = spark.createDataFrame(
        [("c", i, str(i), "n", f"{(i + 1) * 7919 * 104729:012d}" * 2) for i in range(9)],
        "crawl string, page_idx int, url string, next_url string, context string",
    )
    items = spark.createDataFrame([("c", i, str(i)) for i in range(9)], "crawl string, page_idx int, name string")
    links = spark.createDataFrame([], "crawl string, page_idx int, url string")
    rows = G.pagination_stop(pages, items, links, max_pages=4).orderBy("page_idx").collect()
    assert [r.stop_reason for r in rows] == [None] * 3 + ["page_cap"]


def test_number_rows_in_hot_groups(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 7).alias("g"))
    rows = number_rows(df, ["g"], [F.col("id").desc()], "no").collect()
    for g in range(7):
        own = sorted((r for r in rows if r.g == g), key=lambda r: r.no)
        assert [r.no for r in own] == list(range(1, len(own) + 1))
        assert [r.id for r in own] == sorted((r.id for r in own), reverse=True)


def test_crawl_outcome(spark):
    rows = [(1, "category", "/c", None, True), (2, "category", "/c", "e", True), (2, "product", "/p", None, True),
            (3, "category", "/c", "e", False), (4, "discovery", "", "dns", False), (4, "homepage", "/", None, True)]
    units = spark.createDataFrame(rows, "run_id int, kind string, url string, error string, fetched boolean")
    got = {r.run_id: (r.status, r.pages_fetched) for r in G.crawl_outcome(units).collect()}
    assert got == {1: ("success", 1), 2: ("partial_failure", 2), 3: ("failed", 0), 4: ("failed", 1)}
    assert {r.line for r in G.crawl_errors(units).collect()} == {
        "category /c: fetch/extract failed", "discovery: dns"
    }


def test_new_campaigns_twice(spark):
    schema = "seller_id bigint, product_id bigint, discount_text string, title string, n int"
    detected = spark.createDataFrame(
        [(1, None, "10% off", "a", 1), (1, None, "10% off", "b", 2), (1, 5, "10% off", "c", 3), (2, None, "", "d", 4)],
        schema,
    )
    first = C.new_campaigns(detected, detected.limit(0), ["n"])
    assert sorted(r.title for r in first.collect()) == ["a", "c", "d"]
    assert C.new_campaigns(detected, first, ["n"]).isEmpty()


# --- sellers and ranking ----------------------------------------------------------


def test_resolve_seller_against_every_pair(spark):
    rows = [(1, "north-farms", "North Farms"), (2, "north", "North"), (3, "a-b", "A_B 100%"), (4, "x", "Y")]
    sellers = spark.createDataFrame(rows, "seller_id bigint, slug string, name string")
    asked = ["North Farm", "north", "NORTH", "A_B", "100%", "_", "%", "", "nobody", "y", "fa%ms", "rt", "o_t"]
    guesses = spark.createDataFrame([(g,) for g in asked], "guess string")

    def like(text, pattern):
        parts = ["." if c == "_" else ".*" if c == "%" else re.escape(c) for c in pattern]
        return re.search("".join(parts), text, re.I | re.S) is not None

    want = set()
    for g in asked:
        slugged = g.strip().lower().replace(" ", "-").replace("_", "-")
        exact = [s for s in rows if s[1] == g]
        loose = [s for s in rows if like(s[1], slugged) or like(s[2], g)]
        best = min(exact or loose, key=lambda s: (len(s[1]), s[1]), default=None)
        if best:
            want.add((g, best[1]))
    assert {(r.guess, r.slug) for r in S.resolve_seller(guesses, sellers).collect()} == want


def test_resolve_seller_on_random_patterns(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abc-") for _ in range(rng.randint(1, 9))) + f"-{i}",
             "".join(rng.choice("ABc d") for _ in range(rng.randint(1, 9)))) for i in range(60)]
    asked = sorted({"".join(rng.choice("abcd%_- ") for _ in range(rng.randint(0, 6))) for _ in range(250)})

    def like(text, pattern):
        parts = ["." if c == "_" else ".*" if c == "%" else re.escape(c) for c in pattern]
        return re.search("".join(parts), text, re.I | re.S) is not None

    want = set()
    for g in asked:
        slugged = g.strip().lower().replace(" ", "-").replace("_", "-")
        loose = [s for s in rows if like(s[1], slugged) or like(s[2], g)]
        best = min(loose, key=lambda s: (len(s[1]), s[1]), default=None)
        if best:
            want.add((g, best[1], best[0]))
    sellers = spark.createDataFrame(rows, "seller_id bigint, slug string, name string")
    guesses = spark.createDataFrame([(g,) for g in asked], "guess string")
    got = S.resolve_seller(guesses, sellers)
    assert {(r.guess, r.slug, r.seller_id) for r in got.collect()} == want
    table = sellers.select("seller_id", F.lit(1).alias("row"))
    assert {(r.guess, r.seller_id) for r in S.rows_by_guess(guesses, sellers, table).collect()} == {w[::2] for w in want}


def test_sort_products(spark):
    listing = spark.createDataFrame(
        [(1, "b", "x", 5, True), (2, "A", "y", None, None), (3, "c", "x", 7, False)],
        "product_id bigint, name string, category string, latest_price int, in_stock boolean",
    )

    def ids(key, descending=False):
        return [r.product_id for r in S.sort_products(listing, key, descending).collect()]

    assert ids("price") == [2, 1, 3] and ids("price", True) == [3, 1, 2]
    assert ids("name") == [2, 1, 3] and ids("stock", True)[0] == 1


def test_salted_top_n_equals_plain(spark):
    df = spark.range(20000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 20011).alias("v"))
    df = df.withColumn("g", F.when(F.col("id") < 15000, 0).otherwise(F.col("g")))
    order = [F.col("v"), F.col("id")]
    plain = {(r.g, r.id, r.rank_no) for r in top_n(df, ["g"], order, 1500).collect()}
    salted = {(r.g, r.id, r.rank_no) for r in top_n(df, ["g"], order, 1500, salt_on=["id"]).collect()}
    assert plain == salted


def test_rejects_make_each_value_once(spark):
    """How a column is made stands in the plan once, however often the checks look at it."""
    raw = spark.range(9).select(
        *[F.lit("1").alias(c) for c in ("sku", "brand_num", "category", "name", "grade")], F.lit("F25").alias("season"),
        F.when(F.col("id") % 3 == 0, "call us").otherwise(F.concat(F.lit("1"), F.col("id"))).alias("price"), "id",
    )
    found = feed.rejects(raw)
    assert found.columns == [*raw.columns, "reason"]
    assert {(r.id, r.reason) for r in found.collect()} == {(i, "unparseable price: call us") for i in (0, 3, 6)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("THEN call us") == 1


def test_number_rows_sorts_larger_files_in_more_parts(spark, tmp_path, monkeypatch):
    """Ranges follow the size of the files, so a task's rows do not; the session keeps its settings."""
    path, key = str(tmp_path / "listing"), "spark.sql.shuffle.partitions"
    spark.range(20_000).selectExpr("id % 3 AS g", "id").write.parquet(path)
    monkeypatch.setattr(session, "SORTED_BYTES", 4_000)
    before = spark.conf.get(key)
    df = spark.read.parquet(path).groupBy("g", "id").count()
    numbered = number_rows(df, ["g"], [F.col("id")], "no")
    assert session.sorted_parts(df) > 2 * spark.sparkContext.defaultParallelism
    assert len(numbered.inputFiles()) > 2 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == before
    assert numbered.where("no <> id div 3 + 1").count() == 0 and numbered.count() == 20_000


def test_first_import_parses_its_file_once(spark, sf_dir, monkeypatch):
    """Both imports read the parsed feed, not the CSV file."""
    from shelfwatch.plans import load_queries

    seen, run = [], I.import_feed
    monkeypatch.setattr(I, "import_feed", lambda feed, *rest: seen.append(feed.inputFiles()) or run(feed, *rest))
    load_queries.import_first_run(spark, sf_dir)
    assert len(seen) == 2 and all(f.endswith(".parquet") for files in seen for f in files)


def test_new_observations_keep_their_columns(spark):
    """The order's columns come back in place, those of the first row of a key."""
    data = [(1, k % 2, k % 3, "internal_feed", k) for k in (5, 3, 4, 2)] + [(2, 0, 1, "crawl", 9)]
    incoming = spark.createDataFrame(data, "product_id int, observed_at int, n int, source string, m int")
    got = sinks.new_observations(incoming, incoming.limit(0), ["n", "m"])
    assert sorted(got.columns) == sorted(incoming.columns)
    assert sorted(got.select(incoming.columns).collect()) == [(1, 0, 1, "internal_feed", 4), (1, 1, 0, "internal_feed", 3), (2, 0, 1, "crawl", 9)]


def _disk_names(spark):
    """Names of shuffle files, and of tables in the scratch folder."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    shuffles = {files.apply(i).getName() for i in range(files.size())}
    folder = session.shared_dir(spark).removeprefix("file:") + "/shelfwatch"
    return {n for n in shuffles if n.startswith("shuffle_")}, set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_first_import_leaves_only_what_its_result_reads(spark, sf_dir):
    """Shuffle files go with the step that wrote them, tables with their last reader."""
    from shelfwatch.plans import load_queries

    shuffles, tables = _disk_names(spark)
    df = load_queries.import_first_run(spark, sf_dir)
    until = time.time() + 20  # executors delete in the background
    while (left := _disk_names(spark)[0] - shuffles) and time.time() < until:
        time.sleep(0.2)
    assert not left
    kept = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    new = _disk_names(spark)[1] - tables
    assert {n.rsplit("-", 1)[0] for n in new - kept} <= {"new-seller_id"} and kept <= new


def test_first_import_in_parts_gives_the_same_rows(spark, sf_dir, monkeypatch):
    """The file is written, and products and readings are found, part by part."""
    from shelfwatch.plans import load_queries

    path = session.scratch_path(spark, "feed")
    whole = sorted(map(str, load_queries.import_first_run(spark, sf_dir).collect()))
    monkeypatch.setattr(session, "PART_BYTES", 1_000)
    assert sorted(map(str, load_queries.import_first_run(spark, sf_dir).collect())) == whole
    load_queries._write_feed(spark, sf_dir, path)
    parts = sorted(os.listdir(path.removeprefix("file:")))
    assert parts == [f"{n:03d}" for n in range(session.MOST_PARTS)]
    got = feed.read_feed(spark, f"{path}/*").orderBy("row_order").select(*K.FEED_COLUMNS).collect()
    lines = view(spark, sf_dir, "feed_rows").orderBy(*load_queries._FEED_ORDER).select(*K.FEED_COLUMNS).collect()
    assert got == lines


def test_first_import_writes_orders_without_a_number_first(spark, tmp_path, monkeypatch):
    from shelfwatch.plans import load_queries

    monkeypatch.setattr(session, "PART_BYTES", 1)
    when = datetime(2024, 5, 1)
    rows = [(None if n % 5 == 0 else n // 2, n % 3, 1, n % 4, 1.0 + n, "N", "F", when) for n in range(40)]
    spark.createDataFrame(
        rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = [(n, f"part {n}", "Brand#1", "SMALL", n) for n in range(3)]
    spark.createDataFrame(
        parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"
    ).write.parquet(str(tmp_path / "part.parquet"))
    load_queries._write_feed(spark, str(tmp_path), str(tmp_path / "feed"))
    got = feed.read_feed(spark, f"{tmp_path}/feed/*").orderBy("row_order").select("price").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[3]))
    by_key = {}
    for r in order:
        by_key.setdefault((r[0], r[3]), set()).add(f"{r[4]:.2f}")
    at = 0
    for prices in by_key.values():
        assert {r.price for r in got[at : at + len(prices)]} == prices
        at += len(prices)
    assert at == len(got) == 40


def test_import_in_parts_meets_every_row_of_a_product(spark, monkeypatch):
    """A product under two skus has one reading a day, though its rows fall in different parts."""
    monkeypatch.setattr(session, "PART_BYTES", 1)
    skus = [f"S{n}" for n in range(24)]
    placed = [(sku, 1, "c", "n", "g", datetime(2025, 3, 1), n, n) for n, sku in enumerate([*skus, *skus, None])]
    parsed = session.materialise(spark.createDataFrame(
        placed, "sku string, brand_num int, category string, name string, grade string, observed_at timestamp_ntz, "
        "price int, row_order int",
    ), "parsed")
    sellers = spark.createDataFrame([(7, 1)], "seller_id bigint, brand_num int")
    products = spark.createDataFrame(
        [(n % 8, 7, sku) for n, sku in enumerate(skus[:16])], "product_id bigint, seller_id bigint, sku string"
    )
    stored = spark.createDataFrame(
        [(3, datetime(2025, 3, 1), "internal_feed"), (4, datetime(2025, 3, 1), "scheduled_crawl")],
        "product_id bigint, observed_at timestamp_ntz, source string",
    )
    added, readings = I.import_feed(parsed, sellers, products, stored, ("row_order",), True, True)
    rows = added.collect()
    assert sorted(r.sku or "" for r in rows) == ["", *sorted(skus[16:])] and len({r.product_id for r in rows}) == 9
    assert min(r.product_id for r in rows) == 8
    ids = {r.sku: r.product_id for r in rows}
    want = {(n, n) for n in range(8) if n != 3} | {(ids[sku], n) for n, sku in enumerate(skus) if n >= 16}
    assert sorted((r.product_id, r.price) for r in readings.collect()) == sorted(want)
    assert parsed.count() == 49  # a feed written by the caller stays


def test_written_feed_with_an_unknown_brand_fails(spark, monkeypatch):
    """In parts too: no part may leave out the row whose brand has no seller."""
    monkeypatch.setattr(session, "PART_BYTES", 1)
    rows = [(f"S{n}", 1 + (n == 5), "c", "n", "g", datetime(2025, 3, 1), n, n) for n in range(9)]
    parsed = session.materialise(spark.createDataFrame(
        rows, "sku string, brand_num int, category string, name string, grade string, observed_at timestamp_ntz, "
        "price int, row_order int",
    ), "parsed")
    sellers = spark.createDataFrame([(7, 1)], "seller_id bigint, brand_num int")
    products, stored = (spark.createDataFrame([], t) for t in (NO_PRODUCTS, NO_OBSERVATIONS))
    with pytest.raises(Exception, match="no seller for brand number 2"):
        I.import_feed(parsed, sellers, products, stored, ("row_order",), True, True)


def test_feed_rows_carry_the_place_of_their_file(spark, tmp_path):
    """Files count in the order of their names; rows carry a number."""
    (tmp_path / "b c.csv").write_text("S2,5,bulb,Two,A,F25,2\n")
    (tmp_path / "a.csv").write_text("S1,5,bulb,One,A,F25,1\nS3,5,bulb,Three,A,F25,3\n")
    raw = feed.read_feed(spark, str(tmp_path))
    assert dict(raw.select("row_order.*").dtypes) == {"file": "int", "offset": "bigint", "row": "bigint"}
    assert [r.sku for r in raw.orderBy("row_order").collect()] == ["S1", "S3", "S2"]


def test_discard_deletes_only_tables_of_the_scratch_folder(spark, tmp_path):
    path = str(tmp_path / "kept")
    spark.range(3).write.parquet(path)
    session.discard(spark.read.parquet(path))
    written = session.materialise(spark.range(3), "gone")
    files = [f.removeprefix("file:") for f in written.inputFiles()]
    session.discard(written)
    assert spark.read.parquet(path).count() == 3 and files and not any(os.path.exists(f) for f in files)


def test_lean_scratch_puts_the_settings_back(spark):
    key = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(key)
    with session.lean_scratch(spark):
        assert spark.conf.get(key) == "zstd"
    assert spark.conf.get(key) == before

"""Column functions against literal values and plain Python."""

import random
from datetime import datetime
from decimal import Decimal
from urllib.parse import urljoin

import pytest
from pyspark.sql import Window, functions as F

from shelfwatch import constants as K
from shelfwatch.functions import prices as P, similarity as S, text as X, urls as U


def apply(spark, values, function, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", function(F.col("v")).alias("o"))
    return [r.o for r in sorted(df.collect(), key=lambda r: r.i)]


def test_parse_price(spark):
    values = ["19.99", "20", "$19.99", "$1,234.56", "USD 19.99", "call for price", None, "-5.5", "7."]
    got = apply(spark, values, P.parse_price)
    want = ["19.99", "20", "19.99", "1234.56", "19.99", None, None, "5.5", "7"]
    assert got == [None if w is None else Decimal(w) for w in want]


def test_parse_availability(spark):
    values = ["https://schema.org/InStock", "OutOfStock", "x/ SoldOut ", "DISCONTINUED", None, ""]
    assert apply(spark, values, P.parse_availability) == [True, False, False, False, True, True]


def test_parse_season(spark):
    values = ["F25", "S26", " s27 ", "f26", "X99", "F2", "F255"]
    want = [datetime(2025, 9, 1), datetime(2026, 3, 1), datetime(2027, 3, 1), datetime(2026, 9, 1)]
    assert apply(spark, values, P.parse_season) == want + [None, None, None]


def test_feed_price(spark):
    values = ["34.99", "NULL", " null ", "not-a-number"]
    assert apply(spark, values, P.parse_feed_price) == [Decimal("34.99"), None, None, None]
    assert apply(spark, values, P.feed_price_is_bad) == [False, False, False, True]


@pytest.mark.parametrize(
    "spread, step", [(0.0, 0.25), (4.0, 1.0), (7.0, 2.0), (9.0, 2.5), (18.0, 5.0), (30.0, 10.0)]
)
def test_nice_step(spark, spread, step):
    assert apply(spark, [spread], P.nice_step, "double")[0] == pytest.approx(step)


def test_promo_text(spark):
    rows = [("", "20.00", "10.00"), ("Deal", "20.00", "10.00"), ("Deal", "10.00", "10.00"),
            ("", None, "10.00"), ("", "5.00", None)]
    df = spark.createDataFrame(rows, "promo string, o string, p string").select(
        P.promo_text(
            F.col("promo"), F.lit("USD"), F.col("o").cast("decimal(10,2)"), F.col("p").cast("decimal(10,2)")
        ).alias("t")
    )
    assert [r.t for r in df.collect()] == ["Was USD 20.00", "Deal; Was USD 20.00", "Deal", "", "Was USD 5.00"]


def test_truncate_at_word(spark):
    long_words = "alpha " * 20
    no_space = "x" * 100
    values = ["short", long_words, no_space, " " + "y" * 100]
    got = apply(spark, values, X.truncate_at_word)
    assert got[0] == "short"
    assert got[1] == long_words[:77] + "…"
    assert got[2] == "x" * 80 + "…"
    assert got[3] == (" " + "y" * 79) + "…"  # a space in first place is no cut


def test_discount_text(spark):
    """Every mix of the three statements, in any order, gives percent, amount and code in that order."""
    rng = random.Random(17)
    texts, want = [], []
    for _ in range(80):
        percent, amount, code = rng.randrange(1, 100), f"{rng.randrange(1, 99)}.{rng.randrange(10, 99)}", f"K{rng.randrange(10, 999)}"
        said = {"a": (f"{percent}{rng.choice(['', ' '])}% {rng.choice(['off', 'OFF', 'Off'])}", f"{percent}% off"),
                "b": (f"${amount} off", f"${amount} off"), "c": (f"{rng.choice(['code', 'coupon'])}{rng.choice([' ', ': '])}{code}", f"code {code}")}
        drawn = rng.sample(sorted(said), rng.randrange(4))
        texts.append(rng.choice(["", "today "]) + ", now ".join(said[k][0] for k in drawn) + rng.choice(["", "!"]))
        want.append("; ".join(said[k][1] for k in sorted(drawn)))
    others = ["percent off", "off 5%", "$ off", "code x1", "1234% off", "barcode ABCD", "5%off"]
    assert apply(spark, texts, X.discount_text) == want
    assert apply(spark, others, X.discount_text) == ["", "", "", "", "", "code ABCD", "5% off"]


def test_price_context_equals_plain_python(spark):
    rng = random.Random(3)
    texts = ["", "$", "$$$$", "no price", "a$b"] + [
        "".join(rng.choice("ab $é9.") for _ in range(rng.randint(1, 400))) for _ in range(60)
    ]
    want = [
        " ".join(t[max(0, s - 40): s + 40] for s, c in enumerate(t) if c == "$") for t in texts
    ]
    assert apply(spark, texts, X.price_context) == want


def test_print_similarity(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab$") for _ in range(rng.choice([0, 1, 7, 8, 9, 10, 11, 12, 60]))) for _ in range(80)]

    def prints(t):
        codes = [ord(c) for c in t]
        runs = [codes[i : i + 8] for i in range(max(len(t) - 7, 1))] if t else []
        hashes = [
            sum(c * 1_000_003 ** (7 - j) for j, c in enumerate(run)) % 2_147_483_647 for run in runs
        ]
        return {min(hashes[i : i + 4]) for i in range(max(len(hashes) - 3, 1))} if t else set()

    pairs = list(zip(texts, texts[1:])) + [(t, t) for t in texts[:5]] + [("ünï$ 😀漢字 text", "ünï$ 😀漢字 test"), (None, "a")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    score = S.print_similarity(S.context_prints(F.col("a")), S.context_prints(F.col("b")))
    got = [r.s for r in sorted(df.select("i", score.alias("s")).collect(), key=lambda r: r.i)]
    assert got.pop() is None
    sets = [(prints(a), prints(b)) for a, b in pairs[:-1]]
    assert got == pytest.approx([2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0 for x, y in sets])
    rows = df.select("a", S.context_prints(F.col("a")).alias("p")).collect()
    assert all(r.p == (None if r.a is None else sorted(prints(r.a))) for r in rows)


def test_context_pieces(spark):
    """All distinct runs of eight characters have a hash of their own, the same in every text."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab$") for _ in range(rng.choice([0, 1, 7, 8, 9, 60]))) for _ in range(80)]
    texts += ["", "ab", "ab\0", "ünï$ 😀漢字 text", "".join(rng.choices("abcdefgh $", k=1_500_000)), "last of all"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [None])], "i int, t string").coalesce(1)
    rows = df.select("t", S.context_pieces(F.col("t")).alias("p")).collect()
    named = {}
    for r in rows:
        want = {r.t[i : i + 8] for i in range(max(len(r.t) - 7, 1))} if r.t else set()
        assert r.p == (None if r.t is None else sorted(set(r.p))) and len(r.p or []) == len(want)
        if len(want) == 1:
            assert named.setdefault(r.p[0], r.t) == r.t
    score = S.print_similarity(F.lag("p").over(Window.orderBy("i")), F.col("p"))
    pieces = df.where("length(t) < 100").withColumn("p", S.context_pieces(F.col("t")))
    got = [r.s for r in pieces.select("i", score.alias("s")).orderBy("i").collect()]
    sets = [{t[i : i + 8] for i in range(max(len(t) - 7, 1))} if t else set() for t in texts if len(t) < 100]
    assert got[1:] == pytest.approx([2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(sets, sets[1:])])


def test_prints_of_long_texts(spark):
    """A text longer than a slice of work, beside short ones; moved by one character it keeps its prints."""
    long = "".join(random.Random(1).choices("abcdefgh $", k=3_000_000))
    df = spark.createDataFrame([(long, "x" + long), ("", ""), ("a", "b")], "a string, b string")
    rows = df.select(S.print_similarity(S.context_prints(F.col("a")), S.context_prints(F.col("b"))).alias("s")).collect()
    assert rows[0].s > 0.999 and [r.s for r in rows[1:]] == [1.0, 0.0]


def test_keywords(spark):
    got = apply(spark, ["The Red-Hot Poker 12 for your 3-pack RED"], X.keywords)
    assert got == [["red", "hot", "poker", "pack", "red"]]


def test_age_label(spark):
    now = datetime(2026, 1, 10, 12, 0, 0)
    moments = [datetime(2026, 1, 10, 11, 59, 30), datetime(2026, 1, 10, 11, 0, 1),
               datetime(2026, 1, 9, 13, 0, 0), datetime(2026, 1, 1), datetime(2027, 1, 1)]
    got = apply(spark, moments, lambda c: X.age_label(c, F.lit(now)), "timestamp_ntz")
    assert got == ["just now", "59m ago", "23h ago", "9d ago", "just now"]


def random_urls(rng, count):
    pieces = ["/a", "/B.c", "/..", "/.", "//", "/x y", "/é", "/p;v=1", "/~u", "/%7E", "/a*b", "/"]
    params = ["a=1", "b=", "flag", "utm_source=x", "REF=y", "a=%20z", "q=x+y", "k=%zz", "é=ü", "=v", "", "a=b=c",
              "s=*~"]
    for _ in range(count):
        url = rng.choice(["https://Shop.example", "http://www.x.example:8080", "HTTPS://y.example"])
        url += "".join(rng.choice(pieces) for _ in range(rng.randint(0, 4)))
        if rng.random() < 0.7:
            url += "?" + "&".join(rng.choice(params) for _ in range(rng.randint(0, 4)))
        if rng.random() < 0.3:
            url += "#" + rng.choice(["top", "", "a?b"])
        yield url


# Spelling and normal form.
NORMAL_FORMS = {
    "https://a.example": "https://a.example/",
    "https://a.example/": "https://a.example/",
    "https://a.example/x///": "https://a.example/x",
    "https://a.example/x/?": "https://a.example/x",
    "https://a.example/x#top": "https://a.example/x",
    "https://a.example/x?#": "https://a.example/x",
    "https://a.example/?z=1&b=2&a=3": "https://a.example/?a=3&b=2&z=1",
    "https://a.example/?a=2&a=1": "https://a.example/?a=1&a=2",
    "https://a.example/?flag": "https://a.example/?flag=",
    "https://a.example/?q=a%20b+c": "https://a.example/?q=a+b+c",
    "https://a.example/?q=%c3%bc": "https://a.example/?q=%C3%BC",
    "https://a.example/?Ref=1&GCLID=2&gclids=3": "https://a.example/?gclids=3",
    "https://a.example:8443/A/b": "https://a.example:8443/A/b",
}


def test_normal_forms(spark):
    assert apply(spark, list(NORMAL_FORMS), U.normalise) == list(NORMAL_FORMS.values())


def test_normalising_twice_changes_nothing(spark):
    once = apply(spark, list(random_urls(random.Random(11), 400)), U.normalise)
    assert apply(spark, once, U.normalise) == once


def test_order_of_parameters_fragment_and_tracking_do_not_matter(spark):
    rng, left, right = random.Random(12), [], []
    for _ in range(200):
        query = [f"{rng.choice('abc')}={rng.choice(['1', 'x y', 'ü'])}" for _ in range(rng.randrange(1, 5))]
        noise = [f"{rng.choice(K.TRACKING_PARAMS)}={rng.randrange(9)}" for _ in range(rng.randrange(3))]
        mixed = query + noise
        rng.shuffle(mixed)
        path = "https://x.example/" + rng.choice(["", "p", "p/q"])
        left.append(path + "?" + "&".join(query))
        right.append(path + rng.choice(["", "/"]) + "?" + "&".join(mixed) + rng.choice(["", "#f"]))
    assert apply(spark, left, U.normalise) == apply(spark, right, U.normalise)


def test_resolving_against_a_base(spark):
    rng = random.Random(13)
    bases = [u.split("#")[0] for u in random_urls(rng, 60)]
    refs = ["", "leaf", "./leaf", "../leaf", "../../../x", "/root", "//cdn.example/a", "?q=1", "#f", "a/../b",
            "http://o.example/a/../b#z", "mailto:a@b.example", "javascript:void(0)", " /pad", "/a\n/b", "a//b", ".",
            "..", "x/.", "/..", "tel:1", "/a/b-c_1.html", "/a/", "/a;p", "/a.b/..c", "/.h", "https://s.example/a/b",
            "http://S.example/a/", "https://s.example", "/%41/x,y", "/a:b"]
    pairs = [(b, r) for b in bases for r in refs]
    joined = spark.createDataFrame(
        [(i, b, r, urljoin(b, r)) for i, (b, r) in enumerate(pairs)], "i int, b string, r string, whole string"
    )
    rows = joined.select(
        "b", "r", U.normalise(U.resolve(F.col("b"), F.col("r"))).alias("two_steps"),
        U.link_target(F.col("b"), F.col("r")).alias("one_step"), U.normalise(F.col("whole")).alias("want"),
    ).collect()
    assert [r for r in rows if not r.one_step == r.two_steps == r.want] == []


@pytest.mark.parametrize(
    "url, kind",
    [
        ("https://x.example/products/tulip", "product"), ("https://x.example/p/9", "product"),
        ("https://x.example/collections/all", "category"), ("https://x.example/sale", "promotional"),
        ("https://x.example/sales", "unknown"), ("https://x.example/about", "unknown"),
        ("https://x.example/about?u=/products/1", "unknown"), ("/products/a", "product"), ("//shop/a", "unknown"),
        ("https://shop/a", "unknown"), ("/about", "unknown"), ("/deals", "promotional"),
    ],
)
def test_kind_by_path(spark, url, kind):
    assert apply(spark, [url], U.kind_by_path) == [kind]


def test_same_site(spark):
    rows = [("https://www.X.example/a", "https://x.example", True),
            ("https://blog.x.example", "https://x.example", False),
            ("mailto:a@x.example", "https://x.example", False)]
    df = spark.createDataFrame(rows, "a string, b string, w boolean")
    got = df.select(U.same_site(F.col("a"), F.col("b")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)

import random
import re

import pytest

from shelfwatch.llm.decontamination import clean, contamination


def split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(rows, items, n=10):
    windows = {}
    for item, text in items:
        w = split(text)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item if item is None else str(item))
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                ids = windows.get(tuple(w[k : k + size]))
                if ids:
                    hit |= set(range(k, k + size))
                    found |= ids
        out.append((str(i), len(w), len(hit), sorted(found, key=lambda item: (item is None, item))))
    return sorted(out)


@pytest.fixture(scope="module")
def case(odd_rows):
    rng = random.Random(8)
    items = [(k, " ".join(f"q{rng.randrange(30)}" for _ in range(rng.randrange(1, 30)))) for k in range(30)]
    items += [(50, None), (51, ""), (52, "..."), (53, "Only Three, words"), (None, "no id at all"), (None, "only three, words"), (1, items[2][1])]
    rows = list(odd_rows)
    for i in range(700, 760):
        w = [f"q{rng.randrange(30)}" for _ in range(rng.randrange(40))]
        w[:0] = split(rng.choice(items)[1])[: rng.randrange(4, 30)]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    rows.append((800, "x only three WORDS only three words"))
    rows.append((801, "it has No ID at all"))
    return rows, items


@pytest.mark.parametrize("slice_bytes", [1 << 20, 200])
def test_against_every_window(spark, awkward, case, slice_bytes):
    rows, items = case
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    got = contamination(awkward(rows), benchmark, slice_bytes=slice_bytes).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.items)) for r in got) == brute(rows, items)
    assert all(s.start < s.end for r in got for s in r.spans)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 200])
def test_cleaning(spark, awkward, case, slice_bytes, no_docs):
    rows, items = case
    docs, benchmark = awkward(rows), spark.createDataFrame(items, "item_id int, text string")
    want = brute(rows, items)
    dropped = clean(docs, benchmark, slice_bytes=slice_bytes)
    assert dropped.columns == docs.columns
    assert sorted(str(r.doc_id) for r in dropped.collect()) == [w[0] for w in want if not w[2]]
    cut = clean(docs, benchmark, action="cut", slice_bytes=slice_bytes).collect()
    assert len(cut) == len(rows)
    if slice_bytes > 200:
        left = sorted((str(r.doc_id), len(split(r.text))) for r in cut)
        assert left == sorted((w[0], w[1] - w[2]) for w in want)
    assert clean(no_docs, benchmark).count() == 0
    assert clean(docs, benchmark.limit(0)).count() == len(rows)
    assert contamination(no_docs, benchmark).count() == 0

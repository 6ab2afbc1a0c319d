import hashlib
import random
import re

import pytest

from shelfwatch.llm.substrings import pack_rising, remove_repeats, unpack_rising

import numpy as np


def brute(rows, window):
    least = {}
    cut = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = lambda i: float("inf") if i is None else i
    for (i, _), w in zip(rows, cut):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, float("inf")), order(i))
    out = []
    for (i, _), w in zip(rows, cut):
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < order(i):
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("entries", [2_000_000, 20])
def test_odd_documents(awkward, odd_rows, entries):
    assert rows_of(remove_repeats(awkward(odd_rows), slice_entries=entries)) == brute(odd_rows, 13)


@pytest.mark.parametrize("seed", range(4))
def test_random_repeats(awkward, seed):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(6)}" for _ in range(rng.randrange(10, 40))] for _ in range(5)]
    rows = []
    for i in rng.sample(range(1000), 60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p) + 1), 2))
            w += p[a:b] + [f"u{rng.randrange(10)}" for _ in range(rng.randrange(8))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    window = [13, 5, 2, 8][seed]
    assert rows_of(remove_repeats(awkward(rows), window=window, slice_entries=100)) == brute(rows, window)


def test_removed_spans_match_counts(awkward, odd_rows, no_docs):
    for r in remove_repeats(awkward(odd_rows)).collect():
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
    assert remove_repeats(no_docs).count() == 0


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for top in (1, 300, 2**40, 2**63):
        values = np.unique(rng.integers(0, top, 50, dtype=np.uint64))
        assert (unpack_rising(pack_rising(values)) == values).all()

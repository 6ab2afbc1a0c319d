import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from shelfwatch.llm import near, words as W
from shelfwatch.llm.components import components


def bag(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    if 0 < len(w) < 5:
        return Counter([tuple(w)])
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def weighted(a, b):
    if not a or not b:
        return 0.0
    p = {k: v / sum(a.values()) for k, v in a.items()}
    q = {k: v / sum(b.values()) for k, v in b.items()}
    both = set(p) | set(q)
    return sum(
        1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in both) for i in set(p) & set(q)
    )


def classes(rows, threshold=0.8):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or weighted(bags[i], bags[j]) >= threshold:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted(sorted(map(str, g)) for g in groups.values())


def found(df):
    groups, kept = defaultdict(list), Counter()
    rows = df.collect()
    for r in rows:
        groups[r.class_id if r.class_id is not None else r.text_md5].append(str(r.doc_id))
    for r in rows:
        kept[r.class_id if r.class_id is not None else r.text_md5] += r.kept
    assert set(kept.values()) <= {1}
    return sorted(sorted(g) for g in groups.values())


def family(rng, n, changes, length=60):
    base = [f"b{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(length)] = f"c{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_odd_documents(awkward, odd_rows, no_docs):
    rows = [r for r in odd_rows if r[0] not in (400, 401, 501)]  # long texts are too slow for the brute force
    assert found(near.near_duplicates(awkward(rows))) == classes(rows)
    assert near.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("seed,tile", [(0, 256), (1, 4), (2, 2)])
def test_families_of_copies(awkward, seed, tile):
    rng = random.Random(seed)
    texts = [t for c in (1, 2, 3, 6) for t in family(rng, 15, c)] + [f"only {k} of its kind here" for k in range(5)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert found(near.near_duplicates(awkward(rows), tile=tile)) == classes(rows)


def test_long_near_copies_and_kept_rows(awkward, odd_rows, no_docs):
    docs = awkward(odd_rows)
    by_id = {r.doc_id: r for r in near.near_duplicates(docs).collect()}
    assert by_id[400].class_id == by_id[401].class_id == 400
    out = near.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == near.near_duplicates(docs).where("kept").count()
    assert near.drop_near_copies(no_docs).count() == 0


def test_similarity_and_estimate():
    rng = np.random.default_rng(3)
    for _ in range(100):
        pair = []
        for _ in range(2):
            v = np.sort(rng.choice(30, rng.integers(1, 20), replace=False)).astype(np.uint64)
            pair.append((v, rng.integers(1, 5, len(v)).astype(float)))
        want = weighted(*(Counter(dict(zip(v.tolist(), w.tolist()))) for v, w in pair))
        assert near.similarity(*pair) == pytest.approx(want)
    texts = family(random.Random(1), 6, 5)
    data, offsets = W.texts_of(pa.array(texts))
    holder = near.sketch(*near.shingles(W.split(data, offsets, W.LETTERS)), len(texts), registers=4000)
    sets = near.weighted_sets(pa.array(texts))
    for i in range(6):
        for j in range(i):
            assert abs((holder[i] == holder[j]).mean() - near.similarity(sets[i], sets[j])) < 0.05


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 50)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(51)} | {100 + k: 100 for k in range(40)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import boosting, quality, toxicity


def area(label, score):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(label) - ones))


def test_trees_walk_like_one_row_at_a_time():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = boosting.fit(x, y, trees=30, depth=3)
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.97
    for row in x[:40]:
        odds = trees.start
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(feature):
                right = feature[node] >= 0 and row[feature[node]] > threshold[node]
                node = 2 * node + 1 + int(right)
            odds += value[node - len(feature)]
        assert trees.log_odds(row[None])[0] == pytest.approx(odds)
    assert boosting.fit(np.zeros((0, 1)), np.zeros(0)).probability(np.zeros((2, 7))).tolist() == [0.5, 0.5]


@pytest.mark.parametrize(
    "module,query,label,folds,fold,least",
    [(quality, "op7_quality_classifier", "quality", 5, 0, 0.97), (toxicity, "op8_toxicity", "toxic", 4, 2, 0.75)],
)
def test_held_out_rows(spark, module, query, label, folds, fold, least):
    sf_dir = "/root/testdata/sf0.01"
    got = module.QUERIES[query](spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % folds == fold for i in rows.doc_id]).all()
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()
    held = rows[rows.held_out]
    assert area(held[label].to_numpy(), held.score.to_numpy()) >= least
    assert (held.predicted == held[label]).mean() >= 0.9


def test_quality_of_odd_documents(spark, awkward, odd_rows, no_docs):
    docs = awkward(odd_rows)
    labels = spark.createDataFrame(
        [(k, k % 2, None) for k in range(40)] + [(None, 1, 1), (3, None, None), (4, 1, 0), (4, 0, 1), (9999, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    trees = quality.fit_quality(docs, labels)
    scores = quality.score_quality(docs, trees).collect()
    assert len(scores) == len(odd_rows) and all(0 <= r.score <= 1 for r in scores)
    assert len({r.score for r in scores if r.doc_id in (300, 301, 304)}) == 1
    none = quality.fit_quality(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(no_docs, quality.fit_quality(no_docs, labels)).count() == 0


def test_held_out_labels_change_nothing(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn(
        "quality", F.when(quality.fold_of(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    ).withColumn("toxic", F.when(quality.fold_of(F.col("doc_id"), 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (quality.fit_quality(docs, x) for x in (labels, flipped))
    assert all(np.array_equal(x, y) for x, y in zip(a, b))
    a, b = (toxicity.fit_toxicity(docs, x) for x in (labels, flipped))
    for x, y in zip(a, b):
        assert len(x) == len(y) and all(np.array_equal(p, q) for p, q in zip(x, y))


def test_toxic_expressions_and_new_forms_of_them(spark, awkward, no_docs):
    rng = np.random.default_rng(1)
    plain = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(plain, 60))
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            w[rng.integers(60)] = f"nastyw{rng.integers(400)}"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    tests = [(1000, " ".join(rng.choice(plain, 60))), (1001, " ".join([*rng.choice(plain, 50), "nastyword", "nastywine"]))]
    tests += [(1002, None), (1003, ""), (1004, "!!"), (1005, "new words alone"), (None, "w1 w2 w3")]
    docs = awkward(rows + tests)
    given = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, given)
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, model).collect()}
    assert [got[i] for i in (1000, 1001, 1002, 1003, 1004, None)] == [0, 1, 0, 0, 0, 0]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, p in got.items() if not p}
    none = toxicity.fit_toxicity(docs, given.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} == {0}
    assert toxicity.drop_toxic(no_docs, toxicity.fit_toxicity(no_docs, given)).count() == 0


def test_differences_follow_the_counts():
    rng = np.random.default_rng(2)
    before = np.arange(20) % 3
    toxic, plain, contexts = rng.integers(0, 9, 20), rng.integers(0, 9, 20), rng.integers(1, 5, 20)
    of_toxic, of_plain = toxicity.ratio_of(before, toxic, plain, contexts)
    ratio = of_toxic - of_plain
    assert np.isfinite(ratio).all()
    for parent in range(3):
        own = [k for k in range(20) if k % 3 == parent]
        share_t, share_p = toxic[own] / toxic[own].sum(), plain[own] / plain[own].sum()
        clear = np.abs(share_t - share_p) > 0.15
        assert (np.sign(ratio[own][clear]) == np.sign(share_t - share_p)[clear]).all()
        assert np.exp(of_toxic[own]).sum() == pytest.approx(1) and np.exp(of_plain[own]).sum() == pytest.approx(1)


@pytest.mark.parametrize("width", [1 << 20, 500])
def test_continuation_counts_are_distinct_words_before(spark, monkeypatch, width):
    monkeypatch.setattr(toxicity, "WIDTH", width)  # the small one sends pairs several times
    rng = np.random.default_rng(3)
    words = [[f"{a}{rng.integers(40)}" for a in rng.choice(["ab", "xyz", "q", "longer"], 40)] for _ in range(400)]
    words += [["ab", "ab1", "longer", "longer1", "a", "the"]] * 3 + [[]]
    words += [["the" if k % 2 else f"n{k}_{i}" for k in range(60)] for i in range(20)]
    label = rng.integers(-1, 2, len(words))
    want, before = {}, {}
    for kind, text in zip(label, words):
        text = [x for w in text for x in w.split("_")]
        for v, w in zip(["", *text], text):
            counts = want.setdefault(w, [0, 0])
            counts[0] += kind == 1
            counts[1] += kind == 0
            before.setdefault(w, set()).add(v)
    rows = [(int(k) if k >= 0 else None, " ".join(t)) for k, t in zip(label, words)]
    texts = spark.createDataFrame(rows, "label int, body string").repartition(5)
    counted = toxicity.count_words(texts).cache()
    got = sorted((r.toxic, r.plain, r.contexts) for r in counted.collect())
    assert got == sorted((*c, len(before[w])) for w, c in want.items())
    steps = {}
    for w in want:
        chain = ["", w[:4], w[:6], w][: 2 + (len(w) >= 4) + (len(w) >= 6)]
        for level, x in enumerate(chain, -1):
            sums = steps.setdefault((level, x), [0, 0, 0])
            for k, n in enumerate((*want[w], len(before[w]))):
                sums[k] += n
    found = toxicity.events_of(counted).collect()
    seen = sorted((k[0], *v) for k, v in steps.items() if v[0] + v[1])
    assert sorted((r.level, r.toxic, r.plain, r.contexts) for r in found) == seen


def test_unseen_events_need_no_counts():
    before, contexts = np.array([0, 0, 0, 1, 1]), np.array([4, 2, 9, 3, 1])
    toxic, plain = np.array([3, 0, 0, 1, 0]), np.array([1, 2, 0, 0, 0])
    full = np.subtract(*toxicity.ratio_of(before, toxic, plain, contexts))
    around = np.bincount(before, contexts)[before]
    seen = toxic + plain > 0
    parts = before[seen], toxic[seen], plain[seen]
    assert np.subtract(*toxicity.ratio_of(*parts, contexts[seen], around[seen])) == pytest.approx(full[seen])
    assert toxicity.other_of(*parts)[before[~seen]] == pytest.approx(full[~seen], abs=1e-6)


def test_a_pair_of_harmless_words_is_toxic(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(600):
        w = [f"w{k}" for k in rng.integers(0, 300, 60)]
        toxic = i % 4 == 0
        for k in rng.choice(29, 4, replace=False):  # both words stand in all texts, together in toxic ones only
            w[2 * k : 2 * k + 2] = ["green", "horse"] if toxic else [["green", f"w{k}"], ["horse", "green"], [f"w{k}", "horse"]][i % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    known = dict(labels)
    held = [i for i in known if zlib.crc32(str(i).encode()) % 4 == 2]
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, model).collect()}
    assert sum(got[i] == known[i] for i in held) >= 0.95 * len(held)
    without = model._replace(pair=model.pair[:0], pair_ratio=model.pair_ratio[:0], context_ratio=model.context_ratio * 0)
    alone = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, without).collect()}
    assert np.mean([alone[i] for i in held if known[i]]) < 0.6


def test_pairs_leave_the_rest_to_single_words():
    previous = np.array([5, 5, 9], np.uint64)
    counts, totals = [np.array([8.0, 3, 4]), np.array([1.0, 0, 2])], [np.array([20.0, 20, 6]), np.array([40.0, 40, 50])]
    chance = [np.array([0.1, 0.2, 0.3]), np.array([0.05, 0.1, 0.2])]
    ratio, context, left = toxicity.pair_ratios(previous, chance, counts, totals)
    for k in range(3):
        parts = []
        for n, total, p in zip(counts, totals, chance):
            own = [max(n[j] - toxicity.DISCOUNT, 0) / total[j] for j in range(3)]
            rest = 1 - sum(own[j] for j in range(3) if previous[j] == previous[k])
            parts.append((own[k] + rest * p[k], rest))
        assert ratio[k] == pytest.approx(np.log(parts[0][0] / parts[1][0]), abs=1e-5)
        assert left[context.tolist().index(previous[k])] == pytest.approx(np.log(parts[0][1] / parts[1][1]), abs=1e-5)

"""Filter audit against a direct replay of every order, with files that arrive in any order of ids."""

import random
import re
import tempfile
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from shelfwatch.llm import filter_audit


def fails(rows):
    """Set of failed filters of each row (id, text, source)."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        tests = [
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            bool(re.search("[#$%&*|]", text)), i is not None and i > least[text],
        ]
        out.append({f for f, t in zip("ABCDE", tests) if t})
    return out


def brute(rows, labels):
    good, toxic = ({i for i, *l in labels if l[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for (i, _, source), failed in zip(rows, fails(rows)):
        parts[source or ""].append((failed, i in good, i in toxic))
    out = {}
    for part, found in parts.items():
        removed = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = found
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                removed[f] += len(gone)
                failing = [r for r in found if f in r[0]]
                out[part, order, step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(r[0] == {f} for r in found),
                    sum(r[1] for r in gone), sum(r[2] for r in gone),
                ]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(removed[order[step - 1]])
    return out


SCHEMA = "doc_id bigint, text string, source string, part string, mask int, n bigint, key string"


def run(spark, files, labels, batches):
    folder = tempfile.mkdtemp(prefix="audit-")
    for rows in files:
        full = [(*r, "x", 1, 2, "y") for r in rows]
        spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream, size = filter_audit.stream_files(spark, folder, batches)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    counts = filter_audit.count_failures(stream, table, size * 40)
    rows = filter_audit.audit(counts).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in rows}


def random_files(rng, n, files):
    texts = [" ".join(f"w{rng.randrange(k)}" for _ in range(rng.randrange(30, 80))) for k in (20, 60, 900, 900, 900)]
    texts += [t + " #" for t in texts[:3]] + [t.upper() for t in texts[2:]] + [None, "", "x" * 200_000, "\u00e9 " * 60]
    ids = rng.sample(range(10 * n), n)
    rows = [(i, rng.choice(texts + [f"{texts[2]} {i}"] * 6), rng.choice(["a", "a", "a", "b", None, ""])) for i in ids]
    rows += [rows[0], (rows[0][0], rows[0][1], "b"), (rows[1][0], "other text", "a"), (None, texts[0], "a"), (None, "no id", "c")]
    rng.shuffle(rows)
    return rows, [rows[k::files] for k in range(files)]


@pytest.mark.parametrize("files, batches", [(1, 4), (5, 5), (6, 2)])
def test_against_a_replay_of_all_orders(spark, files, batches):
    rng = random.Random(files)
    rows, parts = random_files(rng, 200, files)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for i, _, _ in rows if i is not None and i % 2]
    assert run(spark, parts, labels, batches) == brute(rows, labels)


def test_falling_ids_retract_every_time(spark):
    rows = [(100 - k, "the same text" if k % 3 else "another", "ab"[k % 2]) for k in range(60)]
    labels = [(k, 1, k % 2) for k in range(41, 101, 3)]
    assert run(spark, [rows[k : k + 15] for k in range(0, 60, 15)], labels, 4) == brute(rows, labels)


def test_empty_table(spark):
    assert run(spark, [[]], [], 4) == {}
    assert run(spark, [[(1, None, None)]], [], 4) == brute([(1, None, None)], [])

import hashlib
from collections import defaultdict

import pytest

from shelfwatch.llm.exact import exact_dedup, drop_copies


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("runs,fan_in", [(256, 16), (5, 2), (1, 2)])
def test_against_groups_by_text(awkward, odd_rows, keep, runs, fan_in):
    got = exact_dedup(awkward(odd_rows), keep=keep, runs=runs, fan_in=fan_in).collect()
    groups = defaultdict(list)
    for i, t in odd_rows:
        groups[hashlib.sha256(lower(t).encode()).hexdigest()].append(i)
    assert len(got) == len(odd_rows)
    kept = defaultdict(list)
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        want = None if not known else min(known) if keep == "smallest" else max(known)
        assert (r.keep_id, r.group_size) == (want, len(ids))
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
            assert r.doc_id == want
    assert {k: len(v) for k, v in kept.items()} == dict.fromkeys(groups, 1)


def test_documents_that_stay_keep_their_columns(awkward, odd_rows, no_docs):
    docs = awkward(odd_rows)
    out = drop_copies(docs, keep="largest")
    assert out.columns == docs.columns
    texts = [lower(r.text) for r in out.collect()]
    assert sorted(texts) == sorted({lower(t) for _, t in odd_rows})
    assert drop_copies(no_docs).count() == 0
    assert exact_dedup(no_docs).count() == 0


def test_ids_may_be_strings(spark):
    docs = spark.createDataFrame([("b", "T"), ("a", "t"), (None, "t")], "name string, words string")
    got = exact_dedup(docs, "name", "words").collect()
    assert {(r.name, r.keep_id, r.kept) for r in got} == {("b", "a", False), ("a", "a", True), (None, "a", False)}

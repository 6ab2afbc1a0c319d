"""The pipeline's decisions, each stage judged on its own input."""

from collections import Counter

import corpus_pipeline
from shelfwatch.session import materialise

from .test_decontamination import brute as leaks
from .test_exact import lower
from .test_near import classes


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = [(r.doc_id, r.text) for r in docs.collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if name == "packing":
            break
        assert docs.columns == columns
        after = [(r.doc_id, r.text) for r in docs.collect()]
        assert not Counter(after) - Counter(before)
        if name == "exact_dedup":
            assert sorted(i for i, _ in after) == sorted({lower(t): i for i, t in sorted(before)}.values())
        if name == "near_dedup":
            assert sorted(i for i, _ in after) == sorted(min(map(int, c)) for c in classes(before))
        if name == "decontamination":
            assert sorted(str(i) for i, _ in after) == sorted(x[0] for x in leaks(before, items) if not x[2])
        before = after
    assert {r.doc_id for r in docs.collect()} == {i for i, _ in before}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect())) == sorted(
        map(tuple, docs.drop("sequence_id", "offset").collect())
    )


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0

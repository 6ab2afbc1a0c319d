"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text (lengths, shares of kinds of characters, repetition)
are computed over its whole bytes with array operations. The trees are fitted on
at most ``sample`` labelled rows, those with the smallest hash of their id, and
sent to all tasks as flat arrays of a few kilobytes. Documents are only mapped.

Scores depend on the text alone: id, language, source and label are no inputs.
Rows whose crc32 of the id modulo ``folds`` equals ``held_out`` are never learnt
from.

Defined cases: a null text scores like an empty one; of several labels for an id
the largest counts, null labels and labels without a document are ignored; if
no labels are left every score is one half; repeated rows are scored alike; a
null id is not held out. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfwatch.llm import words as W
from shelfwatch.llm.boosting import Trees, fit

SAMPLE = 20_000
THRESHOLD = 0.3
CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",;:",
    b"!", b"?", b"|", b"#$%&*@^~=+_", b"<>[]{}()/\\", b"\"'`-", bytes(range(128, 256)), bytes([*range(9), *range(11, 32), 127]),
]


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each text."""
    key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for each text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    which = np.repeat(np.arange(n), size)
    histogram = np.bincount(which * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    kinds = np.zeros((256, len(CLASSES)))
    for k, members in enumerate(CLASSES):
        kinds[list(members), k] = 1
    share = histogram / np.maximum(size, 1)[:, None]
    words = W.split(data, offsets, W.LETTERS)
    count = np.diff(words.first)
    owner = words.owner()
    length = words.end - words.start
    per = lambda values: np.bincount(owner, values, n) / np.maximum(count, 1)
    mean = per(length)
    rolled = W.windows(words.hash, 3)
    rolled_owner = owner[: len(rolled)]
    inside = rolled_owner == owner[2:] if len(rolled) else np.zeros(0, bool)
    triples = np.maximum(count - 2, 0)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    gap = words.data[np.minimum(words.end, len(words.data) - 1)]
    opens = words.data[np.maximum(words.start - 1, 0)]
    columns = [
        np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(per(length.astype(float) ** 2) - mean**2, 0)),
        longest, per(length <= 3), per(length >= 9),
        per(gap == 32), per(gap == 46), per(opens == 10),
        _distinct(owner, words.hash, n) / np.maximum(count, 1),
        _distinct(rolled_owner[inside], rolled[inside], n) / np.maximum(triples, 1),
        -(share * np.log(np.maximum(share, 1e-12))).sum(axis=1),
        share.max(axis=1),
    ]
    return np.column_stack([np.column_stack(columns), share @ kinds])


def table_of(column) -> np.ndarray:
    """Statistics of all texts of an Arrow column, piece by piece."""
    parts = [statistics(data, offsets) for _, _, data, offsets in W.pieces(column)]
    return np.concatenate(parts) if parts else np.zeros((0, 14 + len(CLASSES)))


def fold_of(ids: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(folds))


def training_labels(
    labels: DataFrame, id_col: str, label_col: str, folds: int, held_out: int, sample: int
) -> DataFrame:
    """At most ``sample`` (id, label) to learn from, the same ones every time."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    one = usable.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    one = one.where(fold_of(F.col("id"), folds) != held_out)
    return one.orderBy(F.xxhash64("id"), "id").limit(sample)


def _describe(batches):
    W.tidy()
    for batch in batches:
        rows = table_of(batch.column(2))
        values = pa.ListArray.from_arrays(
            np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.astype(np.float64).ravel())
        )
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], names=["id", "label", "x"])


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    label_id_col: str = "doc_id", folds: int = 5, held_out: int = 0, sample: int = SAMPLE, **options,
) -> Trees:
    """Trees fitted to the labels outside the held-out fold."""
    chosen = training_labels(labels, label_id_col, label_col, folds, held_out, sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    kind = docs.schema[id_col].dataType.simpleString()
    joined = texts.join(F.broadcast(chosen), "id").select("id", "label", "body")
    found = joined.mapInArrow(_describe, f"id {kind}, label int, x array<double>").dropDuplicates(["id"]).toArrow()
    found = found.sort_by("id")
    label = np.asarray(found["label"].to_numpy(), dtype=float)
    x = found["x"].combine_chunks()
    rows = np.asarray(x.flatten()).reshape(len(label), -1) if len(label) else np.zeros((0, 1))
    return fit(rows, label, **options)


def _score(sent):
    def run(batches):
        W.tidy()
        for batch in batches:
            score = sent.value.probability(table_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])

    return run


def score_quality(
    docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: id, score (0 to 1) and predicted (1 if the score reaches the threshold)."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    found = texts.mapInArrow(_score(sent), f"id {kind}, score double")
    return found.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """All documents, learnt from labels whose id's crc32 modulo 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return score_quality(docs, trees).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
ORACLES: dict[str, str] = {}

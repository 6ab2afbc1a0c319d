"""Benchmark decontamination by a broadcast set of test n-grams.

Every window of ``n`` words of a test item (an item with fewer words is one
window) goes into a set that all tasks get; a task rolls a window hash over the
words of its documents, looks the hashes up, and compares the words of each hit,
so a hash collision never counts. The documents are only mapped: no shuffle.

The set is broadcast in slices of at most ``slice_bytes`` of item text, a bound
that is checked; a slice takes about 90 times its text in memory, so the bound is
two megabytes. Where the items need more than one slice, each slice is one
written pass, whose set goes before the next one is built, and the passes are put
together by row.

Defined cases: null or empty texts have no words and no hits; an item without
words is ignored; items without an id count as one item whose id is null and
stands last; a repeated item id counts once in a document, a repeated
document row is judged like any other; empty tables give empty or clean results.
Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfwatch.llm import words as W
from shelfwatch.session import materialise

N = 10
SLICE_BYTES = 2 << 20
TABLE_BITS = 20


class Windows:
    """The windows of some items: exact words to item ids, and hashes to find them fast."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.ids: dict[bytes, set[str]] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            data, offsets = W.texts_of(pa.array([text], pa.large_string()))
            words = W.split(data, offsets, W.LETTERS)
            size = min(n, len(words.start))
            if not size:
                continue
            hashes.setdefault(size, []).append(W.windows(words.hash, size))
            for at in range(len(words.start) - size + 1):
                self.ids.setdefault(window_bytes(words, at, size), set()).add(item)
        self.hashes = {size: np.unique(np.concatenate(h)) for size, h in hashes.items()}

    def find(self, words: W.Words) -> tuple[np.ndarray, list[set[str]]]:
        """Whether each word is hit, and the items found in each text."""
        flags, owner = np.zeros(len(words.start), bool), words.owner()
        items: list[set[str]] = [set() for _ in range(len(words.first) - 1)]
        for size, hashes in self.hashes.items():
            table = np.zeros(1 << TABLE_BITS, bool)
            table[hashes >> np.uint64(64 - TABLE_BITS)] = True
            rolled = W.windows(words.hash, size)
            at = np.flatnonzero(table[rolled >> np.uint64(64 - TABLE_BITS)])
            at = at[hashes[np.minimum(np.searchsorted(hashes, rolled[at]), len(hashes) - 1)] == rolled[at]]
            at = at[owner[at] == owner[at + size - 1]]
            true = []
            for place in at.tolist():
                found = self.ids.get(window_bytes(words, place, size))
                if found:
                    true.append(place)
                    items[owner[place]] |= found
            if true:
                flags |= W.covered(np.array(true), size, len(flags))
        return flags, items


def window_bytes(words: W.Words, at: int, size: int) -> bytes:
    """The words of one window, joined by one space."""
    data = words.data
    return b" ".join(data[s:e].tobytes() for s, e in zip(words.start[at : at + size], words.end[at : at + size]))


def slices(benchmark: DataFrame, item_col: str, text_col: str, n: int, slice_bytes: int) -> tuple[int, Iterator]:
    """Number of slices, and broadcasts of the items' windows, each of at most about ``slice_bytes`` of text.

    One item longer than that is a slice of its own. With several, a broadcast is destroyed when the next is asked for.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("body")
    )
    total = items.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    count = max(1, -(-total // slice_bytes))

    def each():
        for k in range(count):
            part = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(count)) == k)
            sent = spark.sparkContext.broadcast(Windows([tuple(r) for r in part.collect()], n))
            yield sent
            if count > 1:
                sent.destroy()

    return count, each()


def _judge(texts, found: Windows) -> dict[str, list]:
    """Counts, item ids and hit spans (in words) of each text of an Arrow column."""
    out: dict[str, list] = {"n_words": [], "items": [], "starts": [], "ends": []}
    for _, _, data, offsets in W.pieces(texts):
        words = W.split(data, offsets, W.LETTERS)
        flags, items = found.find(words)
        step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
        # spans end where a text ends
        first = words.first
        cut = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(flags))]
        cut = np.unique(cut[flags[cut] & flags[cut - 1]])
        begin = np.sort(np.concatenate([np.flatnonzero(step == 1), cut]))
        finish = np.sort(np.concatenate([np.flatnonzero(step == -1), cut]))
        of = np.searchsorted(begin, first)
        for k in range(len(first) - 1):
            out["n_words"].append(int(first[k + 1] - first[k]))
            out["items"].append(sorted(items[k], key=lambda item: (item is None, item)))
            out["starts"].append((begin[of[k] : of[k + 1]] - first[k]).tolist())
            out["ends"].append((finish[of[k] : of[k + 1]] - first[k]).tolist())
    return out


def _mapper(found) -> Callable:
    def run(batches):
        W.tidy()
        for batch in batches:
            judged = _judge(batch.column(batch.schema.names.index("body")), found.value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array(judged["n_words"], pa.int64()), pa.array(judged["items"], pa.list_(pa.string())),
                    pa.array(judged["starts"], pa.list_(pa.int64())), pa.array(judged["ends"], pa.list_(pa.int64())),
                ],
                names=["row", "id", "n_words", "items", "starts", "ends"],
            )

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", n: int = N, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (ids, sorted as strings) and
    spans (first word, word after) covered by windows of test items."""
    count, parts = slices(benchmark, item_col, item_text_col, n, slice_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row bigint, id {kind}, n_words bigint, items array<string>, starts array<bigint>, ends array<bigint>"
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("body")
    )
    if count == 1:
        found = source.mapInArrow(_mapper(next(parts)), schema)
        spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    else:
        source = materialise(source, "decontamination")
        passes = [materialise(source.mapInArrow(_mapper(p), schema), "decontamination") for p in parts]
        every = passes[0]
        for more in passes[1:]:
            every = every.unionByName(more)
        found = every.groupBy("row").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.sort_array(F.flatten(F.collect_list(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))))).alias("found"),
        )
        # join spans that touch or overlap
        spans = F.aggregate(
            "found", F.array().cast("array<struct<start:bigint,end:bigint>>"),
            lambda done, x: F.when(
                (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
                F.concat(
                    F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                    F.array(F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"),
                    )),
                ),
            ).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
        )
    return found.select(F.col("id").alias(id_col), "n_words", "items", spans.alias("spans")).withColumn(
        "n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["end"] - s["start"])
    )


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", n: int = N, action: str = "drop", slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The documents without those that hold a window of a test item (``drop``), or with
    the hit words, and the characters between two of them, cut out (``cut``)."""
    if action not in ("drop", "cut"):
        raise ValueError(f"unknown action {action!r}")
    at = docs.columns.index(text_col)
    names = docs.columns
    count, parts = slices(benchmark, item_col, item_text_col, n, slice_bytes)
    for part in parts:
        docs = docs.mapInArrow(_cleaner(part, at, names, action), docs.schema)
        docs = materialise(docs, "decontamination") if count > 1 else docs
    return docs


def _cleaner(found, at: int, names: list[str], action: str) -> Callable:
    def run(batches):
        W.tidy()
        for batch in batches:
            keep, texts = [], []
            for row, _, data, offsets in W.pieces(batch.column(at)):
                words = W.split(data, offsets, W.LETTERS)
                flags, items = found.value.find(words)
                keep += [not x for x in items]
                if action == "cut":
                    owner, gone = words.owner(), np.zeros(len(words.data), bool)
                    for k in np.flatnonzero(flags):
                        joined = k + 1 < len(flags) and flags[k + 1] and owner[k] == owner[k + 1]
                        gone[words.start[k] : words.start[k + 1] if joined else words.end[k]] = True
                    for k, hit in enumerate(items):
                        raw = data[offsets[k] : offsets[k + 1]]
                        gap = gone[words.text_start[k] : words.text_start[k] + len(raw)]
                        texts.append(raw[~gap].tobytes().decode() if hit else batch.column(at)[row + k].as_py())
            if action == "drop":
                yield batch.filter(pa.array(keep, pa.bool_()))
            else:
                columns = list(batch.columns)
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, ten words."""
    found = contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), tests AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS body
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM tests
), places AS (
    SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS body
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE len(w) >= k)
), hits AS (SELECT DISTINCT doc_id, item_id, i, k FROM places JOIN tests USING (k, body)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT words.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
ORACLES = {"op9_benchmark_decontamination": SQL}

"""Filter interaction audit: what each order of five text filters keeps, as an incremental stream.

The files of a table are taken in as available-now micro-batches. A document's
failures are five bits, A to E. A to D follow from its text; E, being a copy,
changes as documents arrive. A keyed state holds, for every text, the least id
seen so far and the rows that carry it. Its keys are buckets of texts, one for
each ``BUCKET_BYTES`` of files (about a hundred texts), as a call for each text
would cost far more than the work on it. A document with a larger id
fails E for good and goes straight to the counters. When a smaller id arrives,
the state retracts the earlier least document's failures from the counter of its
part and puts them back with E set. What a micro-batch changes is written under
its own number, so a replayed batch overwrites itself, and the counters of a
part are the sums of these changes.

All figures follow from a part's counts of the 32 sets of failures, so the 120
orders are one product of matrices a part.

Tasks reduce their rows before they are dealt out: of equal texts one row of each
batch goes to the state, all others are counted where they are read. So a text
that a third of all rows share costs its bucket one row a batch, and a part of any
size at most 128 counters a batch. State is kept in the checkpoint folder, by the
store that the session names (RocksDB where it exceeds memory); a trigger writes
the buckets it reads texts of.

Defined cases: a null text is empty, a null part an empty string; a null id is
no smaller id and has none, so such rows neither fail E nor make others fail;
rows that repeat an id and its text are counted each and do not fail for each
other; of several labels of an id the largest counts, null and missing labels are
0; an empty table gives no rows. Other columns are not looked at. Texts are
equal when their SHA-256 is.
"""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from shelfwatch.llm import words as W
from shelfwatch.session import scratch_path

FILTERS = "ABCDE"
COPY = 16  # the bit of E
BATCHES = 4
SIGNS = b"#$%&*|"
NO_CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)
CONTINUED = bytes(range(128, 192))  # bytes that do not begin a code point
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
COUNTERS = "part string, mask int, good int, toxic int, n bigint"
BUCKET_BYTES = 1 << 18  # of files for each bucket of texts


def failures(text: bytes) -> int:
    """The bits of A to D that a text in UTF-8 fails."""
    words = text.split()  # of bytes: at the six blanks of ASCII
    tests = [
        len(words) < LEAST_WORDS,
        len(set(words)) * 100 < len(words) * LEAST_DISTINCT,
        len(text.translate(None, NO_CAPITALS)) * 100 > len(text.translate(None, CONTINUED)) * MOST_CAPITALS,
        len(text.translate(None, SIGNS)) < len(text),
    ]
    return sum(1 << k for k, failed in enumerate(tests) if failed)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and failures of the texts in the last column."""
    W.tidy()
    for batch in batches:
        for k in range(0, max(batch.num_rows, 1), 256):  # a copy of so many texts at a time
            rows = batch.slice(k, 256)
            texts = [t or b"" for t in rows.column(2).cast(pa.binary()).to_pylist()]
            found = pa.array([failures(t) for t in texts], pa.int32())
            keys = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([keys, rows.column(0), rows.column(1), found], names=["key", "id", "part", "mask"])


def _reduced(buckets: int):
    """Of each text the rows with the batch's least id, under the text's bucket; all others counted by part.

    Ids are whole numbers or strings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.tidy()
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            # one thread, as others would each keep memory of their own
            rows = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([([], "count_all")])
            least = rows.group_by("key", use_threads=False).aggregate([("id", "min")])
            rows = rows.join(least, "key", use_threads=False)
            rows = rows.to_pandas(ignore_metadata=True, integer_object_nulls=True, use_threads=False)
            known = rows["id"].notna()
            first = known & (rows["id"] == rows["id_min"])
            rows["mask"] += np.where(known & ~first, COPY, 0)
            rest = rows[~first].groupby(["part", "mask", "good", "toxic"], as_index=False)["count_all"].sum()
            kind = batch.schema.field("id").type
            rest["key"], rest["id"] = "", 0 if pa.types.is_integer(kind) else ""  # no nulls, so numbers stay whole
            rest["bucket"] = [-1 - m - 32 * (zlib.crc32(p.encode()) % 64) for m, p in zip(rest["mask"], rest["part"])]
            rows = rows[first]
            rows = rows.assign(bucket=[int(k[:15], 16) % buckets for k in rows["key"]])
            for part in (rows, rest):
                if len(part):
                    part = part.rename(columns={"count_all": "n"})[["bucket", *names, "n"]]
                    schema = [("bucket", pa.int64()), *((f.name, f.type) for f in batch.schema), ("n", pa.int64())]
                    yield pa.RecordBatch.from_pandas(part, schema=pa.schema(schema), preserve_index=False, nthreads=1)

    return run


STATE = ["key", "id", "mask", "good", "toxic", "part", "n"]


def _least_ids(bucket, frames, state):
    """Texts of a bucket -> their least ids and those documents' rows by part; gives the changes of the counters."""
    if random.random() < 0.02:  # groups are many and small, workers are used again
        W.tidy()
    change: Counter = Counter()
    known: dict[str, tuple] = {}  # text -> id, (mask, good, toxic), rows by part
    if state.exists:
        for key, i, mask, good, toxic, part, n in zip(*state.get):
            known.setdefault(key, (i, (mask, good, toxic), {}))[2][part] = n
    for frame in frames:
        for key, i, mask, good, toxic, part, n in zip(*(frame[c].tolist() for c in STATE)):
            labels = (mask, good, toxic)
            least = known.get(key)
            if not key:  # already decided
                change[(part, *labels)] += n
            elif least and i > least[0]:
                change[part, mask | COPY, good, toxic] += n
            else:
                if least and i < least[0]:  # retract
                    for old, m in least[2].items():
                        change[(old, *least[1])] -= m
                        change[old, least[1][0] | COPY, *least[1][1:]] += m
                if not least or i < least[0]:
                    known[key] = least = (i, labels, {})
                least[2][part] = least[2].get(part, 0) + n
                change[(part, *labels)] += n
    if known:
        held = [(k, i, *labels, part, n) for k, (i, labels, parts) in known.items() for part, n in parts.items()]
        state.update(tuple(map(list, zip(*held))))
    rows = [(*k, n) for k, n in change.items() if n]
    yield pd.DataFrame(rows, columns=["part", "mask", "good", "toxic", "n"])


def stream_files(spark: SparkSession, path: str, batches: int = BATCHES) -> tuple[DataFrame, int]:
    """The Parquet files of ``path`` as a stream of about ``batches`` triggers of equal bytes, and all their bytes."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    total = files.getContentSummary(folder).getLength()
    schema = spark.read.parquet(path).schema
    if files.getFileStatus(folder).isFile():  # a stream takes folders and patterns, so a pattern of this one file
        path = f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max(1, -(-total // batches))))
    return stream.parquet(path), total


def changes(
    docs: DataFrame, labels: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
    label_id_col: str = "doc_id",
) -> DataFrame:
    """Changes of the counters (part, mask, good, toxic, n) that the documents of a stream bring."""
    name = docs.schema[id_col].dataType.simpleString()
    one = {
        name: F.coalesce(F.max(F.when(F.col(column) == 1, 1)), F.lit(0)).alias(name)
        for name, column in (("good", "quality"), ("toxic", "toxic"))
    }
    known = labels.groupBy(F.col(label_id_col).alias("label_id")).agg(*one.values())
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text")
    ).mapInArrow(_read, f"key string, id {name}, part string, mask int")
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    rows = rows.join(known, rows["id"] == known["label_id"], "left").select("key", "id", "part", "mask", *flags)
    schema = f"bucket bigint, key string, id {name}, part string, mask int, good int, toxic int, n bigint"
    types = ["string", name, "int", "int", "int", "string", "bigint"]
    held = ", ".join(f"{c} array<{t}>" for c, t in zip(STATE, types))
    keyed = rows.mapInArrow(_reduced(buckets), schema).groupBy("bucket")
    return keyed.applyInPandasWithState(_least_ids, COUNTERS, held, "append", GroupStateTimeout.NoTimeout)


def count_failures(docs: DataFrame, labels: DataFrame, size: int, **columns: str) -> DataFrame:
    """Run a stream of documents, ``size`` bytes of files, to its present end and add up the changes.

    Gives rows by part, failures and labels.
    """
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "filter-audit")
    def write(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        summed.write.mode("overwrite").parquet(f"{path}/counters/batch={number}")

    write(spark.createDataFrame([], COUNTERS), -1)  # so that an empty table has counters
    stream = changes(docs, labels, 1 + size // BUCKET_BYTES, **columns).writeStream.foreachBatch(write)
    stream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    counters = spark.read.schema(f"{COUNTERS}, batch int").parquet(f"{path}/counters")
    return counters.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n != 0")


FIGURES = ["kept", "removed", "redundant", "unique_fails", "shapley"]


def _weights() -> tuple[list[tuple[str, int]], np.ndarray]:
    """Every (order, step), and how often a row with each set of failures counts for each figure there."""
    steps, weight = [], np.zeros((120 * 5, len(FIGURES), 32), np.int64)
    for order in map("".join, permutations(FILTERS)):
        for step, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            earlier = sum(1 << FILTERS.index(c) for c in order[: step - 1])
            for mask in range(32):
                fails, gone = bool(mask & own), bool(mask & earlier)
                # of 120 orders a filter removes the row in as many as put it before the row's other failures
                share = 120 // mask.bit_count() if fails else 0
                weight[len(steps), :, mask] = [not fails and not gone, fails and not gone, fails and gone, mask == own, share]
            steps.append((order, step))
    return steps, weight


def audit(counts: DataFrame) -> DataFrame:
    """Per part, filter order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    totals = [F.sum(F.when(F.col("mask") == m, F.col("n")).otherwise(0)) for m in range(32)]
    lost = [
        F.sum(F.when((F.col("mask") == m) & (F.col(c) == 1), F.col("n")).otherwise(0))
        for c in ("good", "toxic") for m in range(32)
    ]
    parts = counts.groupBy("part").agg(F.array(*totals, *lost).alias("n"))

    def figures(batches):
        steps, weight = _weights()
        orders, places = [s[0] for s in steps], np.array([s[1] for s in steps], np.int32)
        for batch in batches:
            for part, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, good, toxic = np.array(n, np.int64).reshape(3, 32)
                out = dict(zip(FIGURES, (weight @ rows).T))
                removed = weight[:, FIGURES.index("removed")]
                out |= {"good_lost": removed @ good, "toxic_lost": removed @ toxic}
                columns = [pa.array([part] * len(steps)), pa.array(orders), pa.array(places), *map(pa.array, out.values())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *out])

    longs = ", ".join(f"{c} bigint" for c in [*FIGURES, "good_lost", "toxic_lost"])
    return parts.mapInArrow(figures, f"part string, filter_order string, step int, {longs}")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by source, with the labels of quality and toxicity."""
    docs, size = stream_files(spark, f"{sf_dir}/documents.parquet")
    return audit(count_failures(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), size))


QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {
    "op13_filter_audit": """
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS body, coalesce(source, '') AS part FROM documents),
split AS (
    SELECT *, list_filter(string_split_regex(body, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM texts),
known AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
tests AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(w) < 50) AS a, (100 * len(list_distinct(w)) < 65 * len(w)) AS b,
        (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body)) AS c,
        regexp_matches(body, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS e
    FROM split LEFT JOIN known USING (doc_id)),
counts AS (
    SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) AS fails,
        count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
    FROM tests GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
    SELECT v.l || w.l || x.l || y.l || z.l AS filter_order
    FROM letter v, letter w, letter x, letter y, letter z
    WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5),
steps AS (
    SELECT filter_order, step::INT AS step, filter_order[step] AS f, string_split(filter_order[:step - 1], '') AS before
    FROM orders, range(1, 6) t(step)),
figures AS (
    SELECT part, filter_order, step, f,
        coalesce(sum(n) FILTER (NOT list_contains(fails, f) AND NOT list_has_any(fails, before)), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (list_contains(fails, f) AND list_has_any(fails, before)), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails = [f]), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)), 0)::BIGINT AS toxic_lost
    FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM figures"""
}

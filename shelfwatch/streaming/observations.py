"""Streams over price observations: dedup, latest price, price changes.

Streams write to stores in the shared folder. Every write carries the number of its
micro-batch, and a batch that is replayed after a failure overwrites only its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as K
from ..session import scratch_path
from ..sources.sinks import OBSERVATION_KEY

BATCH = "batch_id"
MONTH = "month"
BUCKETS = 16  # parts of a latest table
HELD_ROWS = 1 << 18  # rows a task holds while it cuts them down
STATE_GROUPS = 1 << 15  # values that the products' states share
MOST_OF_PRODUCT = 64  # rows of a product that its group holds while it cuts them down
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, with changes instead of whole snapshots written for each batch."""
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_to_end(stream: DataFrame, path: str, write, mode: str = "append") -> None:
    """Process everything available through ``write(batch, batch_id)`` and stop."""
    with _rocks(stream.sparkSession):
        query = (
            stream.writeStream.foreachBatch(write)
            .outputMode(mode)
            .option("checkpointLocation", f"{path}-checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        try:
            query.awaitTermination()
        finally:
            query.stop()


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a pattern, without their files being listed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return [f.getPath().toString() for f in found or []]


def _delete(spark: SparkSession, folder: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


# --- dedup ---------------------------------------------------------------------


def dedup_writer(path: str, order: list[str]):
    """A sink that stores feed readings once per key and crawled rows as they are.

    Of equal keys the first batch to bring one counts, within a batch the first
    row by ``order``, a total order. The store is partitioned by the month of the
    observation inside each batch's folder; equal keys have equal months, so a
    batch is compared with the stored rows of its own months only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn(MONTH, F.date_format("observed_at", "yyyy-MM")).persist()
        is_feed = F.coalesce(F.col("source") == K.FEED_SOURCE, F.lit(False))
        feed, crawled = batch.where(is_feed), batch.where(~is_feed)
        rest = [c for c in batch.columns if c not in OBSERVATION_KEY]
        first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
        fresh = feed.groupBy(*OBSERVATION_KEY).agg(first).select(*OBSERVATION_KEY, "first.*")
        stored = stored_months(spark, path, feed, batch_id)
        if stored is not None:
            fresh = _without(fresh, stored.where(F.col("source") == K.FEED_SOURCE).select(*OBSERVATION_KEY))
        found = fresh.unionByName(crawled)
        found.write.mode("overwrite").partitionBy(MONTH).parquet(f"{path}/{BATCH}={batch_id}")
        batch.unpersist()

    return write


def _without(rows: DataFrame, stored: DataFrame) -> DataFrame:
    known = stored.select(*[F.col(c).alias(f"stored_{c}") for c in OBSERVATION_KEY])
    same = [F.col(c).eqNullSafe(F.col(f"stored_{c}")) for c in OBSERVATION_KEY]
    return rows.join(known, same, "left_anti")


def stored_months(spark: SparkSession, path: str, batch: DataFrame, batch_id: int) -> DataFrame | None:
    """What other batches have stored for the months of ``batch``; no other folder is opened."""
    months = [r[0] for r in batch.select(MONTH).distinct().collect()]  # one a calendar month
    names = ",".join(re.escape(m) if m else "__HIVE_DEFAULT_PARTITION__" for m in months)
    if not names:
        return None
    folders = _folders(spark, f"{path}/{BATCH}=*/{MONTH}={{{names}}}")
    folders = [f for f in folders if f"/{BATCH}={batch_id}/" not in f]
    schema = batch.drop(MONTH).schema
    return spark.read.schema(schema).parquet(*folders) if folders else None


def store_without_duplicates(stream: DataFrame, order: list[str], path: str | None = None) -> DataFrame:
    """Run the dedup stream into a store and return the stored observations, all columns."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream-dedup")
    run_to_end(stream, path, dedup_writer(path, order))
    if not _folders(spark, f"{path}/{BATCH}=*/{MONTH}=*"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


# --- latest tables ---------------------------------------------------------------


def latest_writer(path: str, key: str = "product_id", buckets: int = BUCKETS):
    """A sink that keeps the last version of every key in a table cut in ``buckets`` by hash.

    A batch rewrites the buckets of the keys it brings, under its own number, from
    their newest earlier versions. Those stay until the next batch, so a batch
    can be replayed; older ones are deleted. The table is read by ``current``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = sorted(r[0] for r in batch.select("bucket").distinct().collect())  # at most ``buckets``
        versions = _versions(spark, path)
        earlier = {b: [v for v in versions.get(b, []) if v < batch_id] for b in touched}
        rows, old = batch, [f"{path}/version={max(v)}/bucket={b}" for b, v in earlier.items() if v]
        if old:
            stored = spark.read.option("basePath", path).schema(batch.schema).parquet(*old)
            known = batch.select(F.col(key).alias("new_key"))
            rows = batch.unionByName(stored.select(*batch.columns).join(
                known, F.col(key).eqNullSafe(F.col("new_key")), "left_anti"))
        if touched:
            dealt = rows.repartition(min(buckets, len(touched)), "bucket")  # a file a bucket
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={batch_id}")
        batch.unpersist()
        for bucket, found in earlier.items():
            for version in sorted(found)[:-1]:
                _delete(spark, f"{path}/version={version}/bucket={bucket}")

    return write


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Bucket -> batches that have written it; at most two for each bucket."""
    out: dict[int, list[int]] = {}
    for folder in _folders(spark, f"{path}/version=*/bucket=*"):
        version, bucket = re.search(r"version=(\d+)/bucket=(\d+)$", folder).groups()
        out.setdefault(int(bucket), []).append(int(version))
    return out


def current(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A latest table as of now: every key is read once."""
    newest = [f"{path}/version={max(v)}/bucket={b}" for b, v in sorted(_versions(spark, path).items())]
    return spark.read.schema(schema).parquet(*newest) if newest else spark.createDataFrame([], schema)


def latest_prices(stream: DataFrame, order: list[str]) -> DataFrame:
    """Newest observation per product, updated as rows arrive.

    Rows are reduced to one per product in each map task before the state.
    """
    kept = ["price", "currency", "in_stock", "observed_at", "source"]
    newest = F.max_by(F.struct(*kept), F.struct(*order)).alias("newest")
    return stream.groupBy("product_id").agg(newest).select("product_id", "newest.*")


def maintain_latest(stream: DataFrame, order: list[str], path: str | None = None) -> DataFrame:
    """Run the latest-price stream into a latest table and return it."""
    path = path or scratch_path(stream.sparkSession, "stream-latest")
    latest = latest_prices(stream, order)
    run_to_end(latest, path, latest_writer(path), mode="update")
    return current(stream.sparkSession, path, latest.schema)


# --- price changes ---------------------------------------------------------------


class LastTwo(StatefulProcessor):
    """Group of products -> the two newest rows of each, the newer one first; one value a group.

    ``rows`` are the columns of a product's row, ``group`` and ``product_id`` first.
    """

    def __init__(self, rows: T.StructType, order: list[str]):
        self.names, self.kept = rows.names[2:], T.StructType(rows.fields[1:])
        self.place = [self.names.index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        product = T.StructType([self.kept["product_id"]])
        for name in ("newest", "before"):
            for field in self.kept.fields[1:]:
                product.add(f"{name}_{field.name}", field.dataType)
        product.add("both", T.BooleanType())
        self.held = handle.getValueState("held", T.StructType().add("products", T.ArrayType(product)))

    def _two(self, found: list[tuple]) -> list[tuple]:
        found.sort(key=lambda r: tuple((r[k] is not None, r[k]) for k in self.place), reverse=True)
        return found[:2]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, touched = len(self.names), {}
        for row in rows:
            found = touched.setdefault(row[1], [])
            found.append(tuple(row[2:]))
            if len(found) > MOST_OF_PRODUCT:
                touched[row[1]] = self._two(found)
        held = self.held.get()
        after = {p[0]: tuple(p) for p in held[0]} if held is not None else {}
        for product, found in touched.items():
            if product in after:
                known = after[product][1:]
                found += [known[:n]] + ([known[n : 2 * n]] if known[2 * n] else [])
            newest, *before = touched[product] = self._two(found)
            after[product] = (product, *newest, *(before[0] if before else [None] * n), bool(before))
        self.held.update(([*after.values()],))
        price = self.names.index("price")
        for product, (newest, *before) in touched.items():
            yield Row(
                product_id=product, latest_price=newest[price], previous_price=before[0][price] if before else None,
                latest_at=newest[self.place[0]],
            )

    def close(self) -> None:
        pass


def _two_newest(order: list[str], most: int = HELD_ROWS):
    """Of every ``most`` rows or so of a task the two newest of every product."""

    def cut(rows: list[pd.DataFrame]) -> pd.DataFrame:
        every = pd.concat(rows, ignore_index=True) if len(rows) > 1 else rows[0]
        newest_last = every.sort_values(order, na_position="first", kind="stable")
        return newest_last.groupby("product_id", sort=False).tail(2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n >= most:
                yield cut(held)
                held, n = [], 0
        if held:
            yield cut(held)

    return run


def price_changes(stream: DataFrame, order: list[str]) -> DataFrame:
    """Last against previous observation of every product a batch touches.

    The first ``order`` column is the event time. Late rows take their place by
    time, so the result after any split into batches equals the batch query.
    Products share ``STATE_GROUPS`` values in RocksDB by hash: Python asks for a value at a time,
    which costs more than the rows do, so a trigger costs what the groups it touches cost, two
    rows a product. With a million products a group has some thirty. Tasks send two rows a
    product and batch at most, so a product with a third of all rows is no heavy key.
    """
    rows = stream.select("product_id", "price", *order).where("product_id IS NOT NULL")
    cut = rows.mapInPandas(_two_newest(order), rows.schema)
    price, at, key = (rows.schema[c].dataType for c in ("price", order[0], "product_id"))
    output = T.StructType().add("product_id", key).add("latest_price", price)
    output = output.add("previous_price", price).add("latest_at", at)
    group = F.pmod(F.xxhash64("product_id"), F.lit(STATE_GROUPS)).alias("group")
    grouped = cut.select(group, "product_id", "price", *order)
    changed = grouped.groupBy("group").transformWithState(LastTwo(grouped.schema, order), output, "update", "none")
    change = F.col("latest_price") - F.col("previous_price")
    share = change.cast("double") / F.col("previous_price").cast("double") * 100
    return changed.withColumn("price_change", change).withColumn(
        "price_change_pct", F.when(F.col("previous_price") != 0, F.round(share, 6))
    )


def maintain_changes(stream: DataFrame, order: list[str], path: str | None = None) -> DataFrame:
    """Run the price-change stream into a latest table and return it."""
    path = path or scratch_path(stream.sparkSession, "stream-changes")
    changes = price_changes(stream, order)
    run_to_end(changes, path, latest_writer(path), mode="update")
    return current(stream.sparkSession, path, changes.schema)

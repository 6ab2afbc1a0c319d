"""Streams over several files against the batch operators."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from shelfwatch.operators import prices as P
from shelfwatch.streaming import observations as O

ORDER = ["observed_at", "n"]
SCHEMA = ("product_id bigint, price decimal(10,2), currency string, in_stock boolean, "
          "observed_at timestamp_ntz, source string, n bigint")


def rows(seed, count):
    rng = random.Random(seed)
    for n in range(count):
        price = None if rng.random() < 0.1 else Decimal(rng.randint(0, 500)) / 100
        product = 1 if rng.random() < 0.4 else rng.randint(1, 30)
        source = rng.choice(["internal_feed", "scheduled_crawl"])
        yield (product, price, "USD", price is not None, datetime(2025, 1, 1) + timedelta(days=rng.randint(0, 20)),
               source, n)


@pytest.fixture()
def landed(spark, tmp_path):
    folder = str(tmp_path / "landing")
    every = list(rows(4, 600))
    for start in range(0, 600, 200):
        part = spark.createDataFrame(every[start:start + 200], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder):
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
    return reader.parquet(folder)


def test_latest_price_equals_batch(spark, landed, tmp_path):
    got = O.maintain_latest(stream(spark, landed), ORDER, str(tmp_path / "latest"))
    want = P.latest_price(spark.read.parquet(landed), ORDER)
    assert set(got.select(want.columns).collect()) == set(want.collect())


def test_price_change_equals_batch(spark, landed, tmp_path):
    got = O.maintain_changes(stream(spark, landed), ORDER, str(tmp_path / "changes"))
    want = P.price_change(spark.read.parquet(landed), ORDER, "2025-12-31 00:00:00", 3650)
    assert set(got.select(want.columns).collect()) == set(want.collect())


def opened(spark, monkeypatch):
    """Folders that the stores read from, in order."""
    seen, read = [], type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths: seen.append(paths) or read(self, *paths))
    return seen


def test_dedup_across_batches(spark, landed, tmp_path):
    path = str(tmp_path / "store")
    stored = O.store_without_duplicates(stream(spark, landed), ORDER, path)
    source = [tuple(r) for r in spark.read.parquet(landed).collect()]
    batches = [[tuple(r) for r in spark.read.schema(SCHEMA).parquet(f).collect()] for f in arrived(spark, path, landed)]
    want, known = [], set()
    for batch in batches:
        for row in sorted(batch, key=lambda r: (r[4], r[6])):
            key = (row[0], row[4], row[5])
            if row[5] == "internal_feed" and key in known:
                continue
            known.add(key)
            want.append(row)
    assert sum(map(len, batches)) == len(source)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in stored.collect())


def arrived(spark, path, landed):
    """The landed files in the order the stream took them."""
    log = spark.read.text(f"{path}-checkpoint/sources/0/[0-9]*").selectExpr(
        "get_json_object(value, '$.path') AS path", "get_json_object(value, '$.batchId') AS batch"
    )
    return [r.path for r in log.where("path IS NOT NULL").distinct().orderBy(log.batch.cast("int")).collect()]


def test_replayed_batch_overwrites_itself(spark, landed, tmp_path):
    path = str(tmp_path / "replay")
    batch = spark.read.parquet(landed)
    write = O.dedup_writer(path, ORDER)
    write(batch, 0)
    first = sorted(map(repr, spark.read.schema(SCHEMA).parquet(f"{path}/batch_id=0").collect()))
    write(batch, 0)
    assert sorted(map(repr, spark.read.schema(SCHEMA).parquet(f"{path}/batch_id=0").collect())) == first
    write(batch, 1)
    second = spark.read.schema(SCHEMA).parquet(f"{path}/batch_id=1")
    assert second.where("source = 'internal_feed'").isEmpty()
    assert second.count() == batch.where("source <> 'internal_feed'").count()


def test_dedup_opens_only_its_months(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "months")
    write = O.dedup_writer(path, ORDER)
    for number, month in enumerate([1, 2, 3, 2, 5]):
        data = [(k, Decimal(1), "USD", True, datetime(2025, month, 3), "internal_feed", 10 * number + k) for k in range(4 + number)]
        seen = opened(spark, monkeypatch)
        write(spark.createDataFrame(data, SCHEMA), number)
        monkeypatch.undo()
        wanted = [f"{path}/batch_id=1/month=2025-02"] if number == 3 else []
        assert [p.removeprefix("file:") for paths in seen for p in paths] == wanted
    assert spark.read.schema(SCHEMA).parquet(f"{path}/batch_id=3").count() == 2  # five of seven were there
    write(spark.createDataFrame([], SCHEMA), 9)


def test_latest_table_rewrites_touched_buckets_only(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "latest"), "product_id bigint, price int"
    write = O.latest_writer(path, buckets=8)
    write(spark.createDataFrame([(k, 0) for k in range(100)], schema), 0)
    batches = {1: [(3, 1), (None, 7)], 2: [(3, 2), (200, 2)], 3: [(5, 3)]}
    want = dict.fromkeys(range(100), 0)
    for number, rows in batches.items():
        for _ in range(2):  # every batch is replayed
            seen = opened(spark, monkeypatch)
            write(spark.createDataFrame(rows, schema), number)
            monkeypatch.undo()
            assert sum(map(len, seen)) <= len(rows)
        want.update(rows)
        table = O.current(spark, path, spark.createDataFrame([], schema).schema)
        assert sorted(map(repr, want.items())) == sorted(repr(tuple(r)) for r in table.collect())
    assert max(map(len, O._versions(spark, path).values())) <= 2


def test_price_change_touches_products_of_the_batch_only(spark, landed, tmp_path):
    folder, path = str(tmp_path / "more"), str(tmp_path / "touched")
    every = [(p, Decimal(1), "USD", True, datetime(2025, 1, 1), "x", p) for p in range(500)]
    spark.createDataFrame(every, SCHEMA).coalesce(1).write.parquet(folder)
    O.maintain_changes(stream(spark, folder), ORDER, path)
    late = [(7, Decimal(3), "USD", True, datetime(2025, 1, 2), "x", 900), (8, Decimal(9), "USD", True, datetime(2024, 1, 2), "x", 901)]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    seen = []
    O.run_to_end(O.price_changes(stream(spark, folder), ORDER), path, lambda b, n: seen.extend(b.collect()), "update")
    assert sorted((r.product_id, r.latest_price, r.previous_price) for r in seen) == [(7, 3, 1), (8, 1, 9)]


def test_streams_of_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    assert O.maintain_latest(stream(spark, folder), ORDER, str(tmp_path / "a")).count() == 0
    assert O.maintain_changes(stream(spark, folder), ORDER, str(tmp_path / "b")).count() == 0
    assert O.store_without_duplicates(stream(spark, folder), ORDER, str(tmp_path / "c")).count() == 0


def test_price_change_state_is_shared_by_groups_of_products(spark, landed, tmp_path, monkeypatch):
    """A trigger asks for a value a group, not a product; the changes are those of the batch."""
    want = P.price_change(spark.read.parquet(landed), ORDER, "2025-12-31 00:00:00", 3650)
    monkeypatch.setattr(O, "STATE_GROUPS", 3)
    monkeypatch.setattr(O, "MOST_OF_PRODUCT", 3)
    path, seen = str(tmp_path / "groups"), {}

    def write(batch, number):
        for r in batch.collect():
            seen[r.product_id] = (r.latest_price, r.previous_price, r.latest_at)

    O.run_to_end(O.price_changes(stream(spark, landed), ORDER), path, write, "update")
    assert seen == {r.product_id: (r.latest_price, r.previous_price, r.latest_at) for r in want.collect()}
    state = spark.read.format("statestore").option("stateVarName", "held").load(f"{path}-checkpoint")
    assert state.count() == 3 and state.selectExpr("sum(size(value.products)) AS n").first().n == len(seen)

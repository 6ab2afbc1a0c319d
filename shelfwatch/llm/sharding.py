"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts are one group and stay together. Groups go, largest
first, into the shard with the least room that still takes them, found in a
balanced tree of remaining capacities.

At any table size the packing itself sees at most ``2 * shards * fine`` things:

- groups heavier than ``total / (shards * fine)``, of which there can be no more
  than ``shards * fine``, are packed one by one;
- lighter groups are first put in ``shards * fine`` parcels by a hash of the
  text, whole groups only, and the parcels are packed.

So both lists fit the driver and a broadcast by proof, not by luck. The law is
``bytes``: sizes near equal. Since groups are indivisible, a group heavier than
an equal share of all bytes has a shard of its own, the share then being that of
the other groups in the other shards, until none exceeds it. For those others
the capacity is the least at which best fit needs no more than the shards left.

Defined cases: a null text is a group with the empty ones (0 bytes, plus 1);
repeated rows are members of their group like any others; a null id is a value
like any other; an empty table gives an empty result. Other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, functions as F

from shelfwatch.llm.numbering import number_within
from shelfwatch.session import materialise

SHARDS = 16
FINE = 2048


class RoomTree:
    """Bins by remaining room: a two-level balanced search tree of (room, bin)."""

    def __init__(self, width: int = 512):
        self.width, self.leaves, self.tops = width, [], []

    def add(self, room: int, box: int) -> None:
        at = min(bisect_left(self.tops, (room, box)), len(self.leaves) - 1)
        if at < 0:
            self.leaves, self.tops = [[(room, box)]], [(room, box)]
            return
        leaf = self.leaves[at]
        insort(leaf, (room, box))
        if len(leaf) > self.width:
            half = len(leaf) // 2
            self.leaves[at : at + 1] = [leaf[:half], leaf[half:]]
            self.tops[at : at + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self.tops[at] = leaf[-1]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room of at least ``size``."""
        at = bisect_left(self.tops, (size, -1))
        if at == len(self.leaves):
            return None
        leaf = self.leaves[at]
        found = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[at] = leaf[-1]
        else:
            del self.leaves[at], self.tops[at]
        return found


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size (given in falling order); None if more than ``most`` bins are needed.

    A size above ``capacity`` has a bin of its own.
    """
    tree, bins, out = RoomTree(), 0, []
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            if bins == most:
                return None
            found, bins = (max(capacity, size), bins), bins + 1
        room, box = found
        tree.add(room - size, box)
        out.append(box)
    return out


def least_capacity(sizes: list[int], shards: int) -> list[int]:
    """The packing of ``sizes`` (falling) in at most ``shards`` bins.

    A size above an equal share of what is left has a bin of its own, the share
    being taken anew after each; the others go in the remaining bins at the
    least capacity.
    """
    if not sizes:
        return []
    alone, left = 0, sum(sizes)
    while shards - alone > 1 and alone < len(sizes) and sizes[alone] * (shards - alone) > left:
        left -= sizes[alone]
        alone += 1
    return [*range(alone), *(alone + box for box in _least_capacity(sizes[alone:], shards - alone))]


def _least_capacity(sizes: list[int], shards: int) -> list[int]:
    if not sizes:
        return []
    low = max(-(-sum(sizes) // shards), sizes[0])
    got = best_fit_decreasing(sizes, low, shards)
    if got is not None:
        return got
    step = max(1, low // 4096)
    high = low + step
    while (got := best_fit_decreasing(sizes, high, shards)) is None:
        low, step = high, 2 * step
        high = low + step
    for _ in range(10):
        if high - low <= 1:
            break
        middle = (low + high) // 2
        if (better := best_fit_decreasing(sizes, middle, shards)) is None:
            low = middle
        else:
            high, got = middle, better
    return got


def shard(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, fine: int = FINE
) -> DataFrame:
    """One row per document: id, size (UTF-8 bytes plus 1), text_crc32, shard and slot (gapless in its shard)."""
    spark, parcels = docs.sparkSession, shards * fine
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("crc"),
        F.unhex(F.md5(body)).alias("digest"),
    )
    rows = materialise(rows.withColumn("parcel", F.pmod(F.xxhash64("digest"), F.lit(parcels)).cast("int")), "sizes")
    groups = materialise(rows.groupBy("digest", "parcel").agg(F.sum("size").alias("weight")), "groups")
    total = groups.agg(F.sum("weight").alias("n")).first()["n"] or 0
    heavy = F.col("weight") * F.lit(parcels) > F.lit(total)
    large = groups.where(heavy).select("weight", "digest").collect()
    small = groups.where(~heavy).groupBy("parcel").agg(F.sum("weight").alias("weight")).collect()
    things = sorted(
        [(r["weight"], 0, bytes(r["digest"])) for r in large] + [(r["weight"], 1, r["parcel"]) for r in small],
        key=lambda t: (-t[0], t[1], t[2] if t[1] else 0, b"" if t[1] else t[2]),
    )
    place = least_capacity([t[0] for t in things], shards)
    single = [(bytearray(t[2]), p) for t, p in zip(things, place) if t[1] == 0]
    parcel = [(t[2], p) for t, p in zip(things, place) if t[1] == 1]
    singles = spark.createDataFrame(single, "digest binary, own_shard int")
    bundles = spark.createDataFrame(parcel, "parcel int, parcel_shard int")
    placed = (
        rows.join(F.broadcast(singles), "digest", "left").join(F.broadcast(bundles), "parcel", "left")
        .select("row", "id", "size", "crc", F.coalesce("own_shard", "parcel_shard").alias("shard"))
    )
    numbered = number_within(placed, ["shard"], ["id", "row"], "slot")
    return numbered.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot"
    )


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op6_sharding": op6_sharding}
ORACLES: dict[str, str] = {}

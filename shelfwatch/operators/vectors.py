"""Nearest news items by embedding, inside a seller: exact search over ball partitions.

A few items serve as pivots. Every item belongs to the ball of its nearest pivot;
a ball of a seller is known by its number of items and its radius. By the triangle
inequality (on unit vectors, whose distance squared is twice the cosine
distance) the balls bound the distance of a query's k-th neighbour from above and
each ball's distance from below, so a query only visits the balls that may
hold a neighbour. Balls and their visitors meet in blocks of bounded size, one
matrix product each, that keep k items a query; Spark cuts these down to k a query
again in every task before they are shuffled. So no task holds a whole ball, and
no pair of item and query is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.ranking import top_n
from ..session import materialise

PIVOTS = 256  # items that are collected and sent to all tasks
BLOCK = 4096  # items and queries that meet at a time
SLACK = 1e-6  # of distances, for rounding in the bounds
NOWHERE = -1  # ball of the vectors without length


def nearest(
    items: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, block: int = BLOCK
) -> DataFrame:
    """The ``k`` items of each query's seller with the smallest cosine distance.

    ``items``: development_id, seller_id, embedding. ``queries``: query_id,
    seller_id, embedding. Distances count to twelve digits, ties go to the lowest
    id. A vector of no length has no distance and comes last; a query of no
    length gets the lowest ids. Vectors and sellers without a value are left out.
    """
    centres = _centres(items, pivots)
    placed = _placed(items, centres)
    balls = placed.groupBy("seller_id", "ball").agg(
        F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius")
    )
    visits = _visits(queries, balls, centres, k)
    crowds = visits.groupBy("seller_id", "ball").agg(F.count(F.lit(1)).alias("visitors"))
    sizes = balls.join(crowds, ["seller_id", "ball"]).select(
        "seller_id", "ball",
        F.ceil(F.col("n") / block).alias("item_blocks"), F.ceil(F.col("visitors") / block).alias("query_blocks"),
    )

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.col(f"{own}_blocks"))
        return rows.join(sizes, ["seller_id", "ball"]).select(
            "seller_id", "ball", key, "embedding", mine.alias(f"{own}_block"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block"),
        )

    blocks = ["seller_id", "ball", "item_block", "query_block"]
    found = (
        dealt(placed, "development_id", "item", "query").groupBy(*blocks)
        .cogroup(dealt(visits, "query_id", "query", "item").groupBy(*blocks))
        .applyInArrow(_closest(k), "query_id bigint, development_id bigint, distance double")
    )
    nearest_first = [F.col("distance").asc_nulls_last(), F.col("development_id")]
    return top_n(found, ["query_id"], nearest_first, k)


def _centres(items: DataFrame, pivots: int) -> np.ndarray:
    """Unit vectors of the items with the smallest hashes; equal for every call on a table."""
    some = (
        items.where(F.exists("embedding", lambda x: x != 0))
        .select("embedding", F.xxhash64("development_id").alias("hash"), "development_id")
        .orderBy("hash", "development_id").limit(pivots).collect()
    )
    return _unit(np.array([r["embedding"] for r in some], dtype="float64")) if some else np.zeros((0, 1))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / length


def _apart(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (vectors @ centres.T), 0))


def _placed(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """The items with their ball and their distance from its centre."""
    sent = items.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                unit = _unit(_matrix(rows.column(2)))
                known = ~np.isnan(unit[:, 0])
                ball, radius = np.full(len(unit), NOWHERE), np.zeros(len(unit))
                if known.any():
                    apart = _apart(unit[known], sent.value)
                    ball[known], radius[known] = apart.argmin(axis=1), apart.min(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(ball, pa.int32()), pa.array(radius)], names=[*rows.schema.names, "ball", "radius"]
                )

    columns = items.select("development_id", "seller_id", "embedding").where("embedding IS NOT NULL AND seller_id IS NOT NULL")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema)
    return materialise(columns.mapInArrow(place, f"{fields}, ball int, radius double"), "balls")


def reachable(apart: np.ndarray, radius: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Which balls may hold one of the k nearest: distances to their centres, radii and sizes."""
    most = apart + radius
    order = np.argsort(most)
    enough = np.searchsorted(np.cumsum(n[order]), k)
    bound = most[order][enough] if enough < len(order) else np.inf
    return apart - radius <= bound + SLACK


def _visits(queries: DataFrame, balls: DataFrame, centres: np.ndarray, k: int) -> DataFrame:
    """One row for every query and ball of its seller that it must look into."""
    sent = queries.sparkSession.sparkContext.broadcast(centres)
    of_seller = balls.groupBy("seller_id").agg(F.collect_list(F.struct("ball", "radius", "n")).alias("balls"))
    asked = queries.select("query_id", "seller_id", "embedding").where("embedding IS NOT NULL")
    asked = asked.join(of_seller, "seller_id").select("query_id", "seller_id", "embedding", "balls")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, chosen = _unit(_matrix(batch.column(2))), []
            for vector, own in zip(unit, batch.column(3).to_pylist()):
                ball, radius, n = (np.array([b[c] for b in own]) for c in ("ball", "radius", "n"))
                if np.isnan(vector[0]):  # all items are alike to it
                    chosen.append(ball.tolist())
                    continue
                real = ball != NOWHERE
                apart = _apart(vector[None], sent.value[ball[real]])[0] if real.any() else np.zeros(0)
                near = ball[real][reachable(apart, radius[real], n[real], k)].tolist()
                chosen.append(near + [NOWHERE] * bool((~real).any() and n[real].sum() < k))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(chosen, pa.list_(pa.int32()))], names=[*batch.schema.names[:3], "balls"]
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.drop("balls").schema)
    chosen = asked.mapInArrow(choose, f"{fields}, balls array<int>")
    return materialise(chosen.select("query_id", "seller_id", "embedding", F.explode("balls").alias("ball")), "visits")


def _closest(k: int):
    """The k nearest items of a block for each query of a block; ties at the edge go to the lowest id."""

    def closest(items: pa.Table, asked: pa.Table) -> pa.Table:
        names, queries = items["development_id"].to_numpy(), asked["query_id"].to_numpy()
        if not len(names) or not len(queries):
            names, queries, distances = names[:0], queries[:0], np.zeros((0, 0))
        else:
            order = np.argsort(names)
            names = names[order]
            distances = 1.0 - _unit(_matrix(asked["embedding"])) @ _unit(_matrix(items["embedding"])[order]).T
        best = np.argsort(np.round(distances, 12), axis=1, kind="stable")[:, :k]
        distance = np.take_along_axis(distances, best, axis=1).round(12).ravel()
        return pa.table(
            {
                "query_id": pa.array(np.repeat(queries, best.shape[1]), pa.int64()),
                "development_id": pa.array(names[best.ravel()], pa.int64()),
                "distance": pa.array(distance, pa.float64(), mask=np.isnan(distance)),
            }
        )

    return closest

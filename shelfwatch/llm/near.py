"""Near-duplicate detection with ProbMinHash, banding and exact verification.

A text is the weighted set of its five-word shingles (a text of fewer words is
one shingle), the weight being how often one occurs. ProbMinHash draws for each
shingle the arrivals of a Poisson process whose rate is its weight; an arrival
claims a random register if it is the earliest there, and a shingle stops as
soon as its next arrival is later than all registers. Two texts agree in a
register with the probability Jaccard of their weighted sets, which for equal
weights is the plain Jaccard similarity of the sets.

1. Equal texts become one representative, before anything is compared.
2. ``BANDS`` bands of ``ROWS`` registers: texts that agree in a whole band share
   a bucket. At similarity 0.8 a pair misses all bands once in 20,000.
3. In each bucket every member is compared with the bucket's hub, its least
   member: one pair a member, however large the group. The comparison is exact,
   on whole texts. Links of 0.8 or more join components.
4. The rest: where members of a bucket that are not its hub are still in several
   components, all pairs across components are compared, in tiles of
   ``2 * TILE`` members, so a large bucket is many tasks. Members of its largest
   component never meet each other, so a component of a third of all texts costs
   its size times the others beside it, not its square. Pairs whose registers
   agree too little for 0.8 (five standard deviations) are dropped there, the
   others compared exactly. A pair that the tile has already connected adds
   nothing, so at most one link a member leaves a tile.

Classes are the connected components of the links. No candidate, partner or
bucket is capped.

Defined cases: a null text counts as empty; texts without words are in one class
only if equal; ids may be of any orderable type, a class has the id of its
smallest non-null id; repeated rows are one text, of which one row is kept; an
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfwatch.llm import words as W
from shelfwatch.llm.components import components
from shelfwatch.session import materialise

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 25
ROWS = 5
REGISTERS = BANDS * ROWS
TILE = 256
VERIFY_ROWS = 128


def shingles(words: W.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of all texts, by text and then by shingle."""
    owner, count = words.owner(), np.diff(words.first)
    rolled = W.windows(words.hash, size)
    inside = owner[: len(rolled)] == owner[size - 1 :] if len(rolled) else np.zeros(0, bool)
    texts, values = [owner[: len(rolled)][inside]], [rolled[inside]]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            value = np.zeros(len(short), np.uint64)
            for k in range(n):
                value = value * np.uint64(W.BASE) + words.hash[words.first[short] + k]
            texts.append(short)
            values.append(W.mix(value + np.uint64(n)))
    text, value = np.concatenate(texts), np.concatenate(values)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text))).astype(np.float64)


def sketch(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """(n, registers): the shingle that holds each register; 0 where a text has none."""
    earliest = np.full(n * registers, np.inf)
    holder = np.zeros(n * registers, np.uint64)
    time = np.zeros(len(text))
    live, drawn = np.arange(len(text)), 0
    while len(live):
        last = earliest.reshape(n, registers).max(axis=1)
        live = live[time[live] < last[text[live]]]
        each = max(1, min(64, 100_000 // max(len(live), 1)))  # few shingles left: several arrivals at once
        steps = np.arange(drawn + 1, drawn + each + 1, dtype=np.uint64) * np.uint64(W.BASE)
        drawn += each
        bits = W.mix(value[live][:, None] ^ W.mix(steps)[None, :])
        gap = -np.log(((bits >> np.uint64(20)).astype(np.float64) + 0.5) * 2.0**-44) / weight[live][:, None]
        at = time[live][:, None] + np.cumsum(gap, axis=1)
        time[live] = at[:, -1]
        place = (text[live] * registers)[:, None] + (((bits & np.uint64(0xFFFFF)) * np.uint64(registers)) >> np.uint64(20)).astype(np.int64)
        at, place = at.ravel(), place.ravel()
        who = np.repeat(value[live], each)
        first = at < earliest[place]
        at, place, who = at[first], place[first], who[first]
        np.minimum.at(earliest, place, at)
        won = at == earliest[place]
        holder[place[won]] = who[won]
    return holder.reshape(n, registers)


def band_keys(holder: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket keys, different from band to band."""
    n = len(holder)
    by_band = W.mix(holder).reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)).copy()
    for k in range(ROWS):
        key = W.mix(key * np.uint64(W.BASE) + by_band[:, :, k])
    return key.view(np.int64)


def _sketches(batches):
    W.tidy()
    for batch in batches:
        keys, bytes_, sizes = [], [], []
        for _, _, data, offsets in W.pieces(batch.column(3)):
            text, value, weight = shingles(W.split(data, offsets, W.LETTERS))
            n = len(offsets) - 1
            holder = sketch(text, value, weight, n)
            keys.append(band_keys(holder))
            bytes_.append((W.mix(holder) & np.uint64(255)).astype(np.uint8))
            sizes.append(np.bincount(text, minlength=n))
        if not keys:
            continue
        keys, bytes_, sizes = np.concatenate(keys), np.concatenate(bytes_), np.concatenate(sizes)
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:3], pa.array(sizes.astype(np.int64)),
                pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel())),
                pa.array([r.tobytes() for r in bytes_], pa.binary()),
            ],
            names=["row", "id", "digest", "n_shingles", "keys", "registers"],
        )


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets (sorted values, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    p, q = a[1] / a[1].sum(), b[1] / b[1].sum()
    if p[0] == p[-1] and q[0] == q[-1] and (p == p[0]).all() and (q == q[0]).all():
        return len(ia) / (len(p) + len(q) - len(ia))
    x, y = p[ia], q[ib]
    only_a, only_b = p.sum() - x.sum(), q.sum() - y.sum()
    order = np.argsort(x / y)  # sum of max(p_j / x, q_j / y): p where its ratio is greater, q elsewhere
    x, y = x[order], y[order]
    above = only_a + np.concatenate([np.cumsum(x[::-1])[::-1][1:], [0.0]]) + x
    below = only_b + np.concatenate([[0.0], np.cumsum(y)[:-1]])
    return float((1 / (above / x + below / y)).sum())


def weighted_sets(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted shingles, weights) of each text of an Arrow column."""
    out = []
    for _, _, data, offsets in W.pieces(texts):
        text, value, weight = shingles(W.split(data, offsets, W.LETTERS))
        at = np.searchsorted(text, np.arange(len(offsets)))
        out += [(value[s:e], weight[s:e]) for s, e in zip(at[:-1], at[1:])]
    return out


def _verify(threshold: float):
    def run(batches):
        W.tidy()
        for batch in batches:
            names = batch.schema.names
            for start in range(0, batch.num_rows, VERIFY_ROWS):
                part = batch.slice(start, VERIFY_ROWS)
                left, right = (weighted_sets(part.column(names.index(c))) for c in ("body_a", "body_b"))
                keep = pa.array([similarity(x, y) >= threshold - 1e-12 for x, y in zip(left, right)], pa.bool_())
                yield part.select(["a", "b"]).filter(keep)

    return run


def _tile(threshold: float):
    agree = REGISTERS * threshold - 5 * np.sqrt(REGISTERS * threshold * (1 - threshold))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, label, key = (np.asarray(table[c]) for c in ("node", "label", "key"))
        registers = np.stack([np.frombuffer(x, np.uint8) for x in table["registers"].to_pylist()])
        keys = np.asarray(table["keys"].combine_chunks().flatten()).reshape(len(node), BANDS)
        here = np.flatnonzero(keys[0] == key[0])[0]
        sets = None
        left = np.asarray(table["side"]) == 0
        alone = table["low"][0].as_py() == table["high"][0].as_py() and not table["major"][0].as_py()
        right = left if alone else ~left
        group = np.unique(label, return_inverse=True)[1]  # what is connected so far, here
        out_a, out_b = [], []
        for k in np.flatnonzero(left):
            others = np.flatnonzero(right & (group != group[k]) & ((node > node[k]) | (not alone)))
            others = others[(registers[others] == registers[k]).sum(axis=1) >= agree]
            # a pair that shares an earlier band is met there
            others = others[~(keys[others, :here] == keys[k, :here]).any(axis=1)]
            if len(others) and sets is None:
                sets = weighted_sets(table["body"])
            for other in others.tolist():
                if group[other] != group[k] and similarity(sets[k], sets[other]) >= threshold - 1e-12:
                    out_a.append(node[k])
                    out_b.append(node[other])
                    group[group == group[other]] = group[k]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def representatives(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: row, id, digest, sketch, and the row that stands for all equal texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    body = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.unhex(F.md5(body.cast("binary"))).alias("digest"), body.alias("body"),
    )
    return source.mapInArrow(
        _sketches, f"row bigint, id {kind}, digest binary, n_shingles bigint, keys array<bigint>, registers binary"
    )


def texts_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, body) of the representatives in ``nodes`` (node, id, digest), one row each."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc"), F.unhex(F.md5(body.cast("binary"))).alias("mark"), body.alias("body"))
    same = (texts["mark"] == nodes["digest"]) & texts["doc"].eqNullSafe(nodes["id"])
    return texts.join(nodes, same).select("node", "body").dropDuplicates(["node"])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tile: int = TILE
) -> DataFrame:
    """One row per document: id, class_id, class_size, kept (one of each class) and text_md5."""
    rows = materialise(representatives(docs, id_col, text_col), "sketches")
    texts = materialise(
        rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best"), F.count(F.lit(1)).alias("copies"))
        .select("digest", F.col("best.row").alias("node"), F.col("best.id").alias("id"), "copies"),
        "texts",
    )
    sketches = (
        rows.where("n_shingles > 0").select(F.col("row").alias("node"), "keys", "registers")
        .join(texts.select("node", "id", "digest"), "node")
    )
    posted = sketches.select("node", F.explode("keys").alias("key"))
    hubs = posted.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = materialise(posted.join(hubs, "key").where("node != hub").select("key", "node", "hub", "n"), "stars")
    pairs = stars.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    members = stars.select("node").union(stars.select(F.col("hub").alias("node"))).distinct()
    bodies = materialise(texts_of(docs, texts.join(members, "node").select("node", "id", "digest"), id_col, text_col), "bodies")
    body_a = bodies.select(F.col("node").alias("a"), F.col("body").alias("body_a"))
    body_b = bodies.select(F.col("node").alias("b"), F.col("body").alias("body_b"))
    links = materialise(
        pairs.join(body_a, "a").join(body_b, "b").mapInArrow(_verify(threshold), "a bigint, b bigint"), "links"
    )
    labels = components(links)

    # The rest: members other than the hub that are in several components.
    labelled = stars.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    parts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(
        F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")
    ).where("labels > 1").select(
        "key", F.col("top.label").alias("top"), F.ceil(F.col("top.n") / tile).cast("int").alias("top_chunks"),
        F.ceil((F.col("n") - F.col("top.n")) / tile).cast("int").alias("rest_chunks"),
    )
    dealt = labelled.join(materialise(mixed, "mixed"), "key")
    spot = F.xxhash64("node", "key")
    beside = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    member = ["key", "node", "label"]
    of_top = dealt.where("label = top").select(
        *member, F.pmod(spot, "top_chunks").cast("int").alias("low"), beside("rest_chunks")
    ).select(*member, F.lit(True).alias("major"), "low", F.col("other").alias("high"), F.lit(0).alias("side"))
    rest = dealt.where("label <> top").withColumn("chunk", F.pmod(spot, "rest_chunks").cast("int"))
    with_top = rest.select(*member, "chunk", beside("top_chunks")).select(
        *member, F.lit(True).alias("major"), F.col("other").alias("low"), F.col("chunk").alias("high"), F.lit(1).alias("side")
    )
    among = rest.select(*member, "chunk", beside("rest_chunks")).select(
        *member, F.lit(False).alias("major"), F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
        F.when(F.col("chunk") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    tiles = of_top.unionByName(with_top).unionByName(among)
    full = tiles.join(sketches.select("node", "keys", "registers"), "node").join(bodies, "node")
    more = materialise(
        full.groupBy("key", "major", "low", "high").applyInArrow(_tile(threshold), "a bigint, b bigint"), "links"
    )
    if not more.isEmpty():
        labels = components(links.union(more))

    of_text = materialise(
        texts.join(labels, "node", "left").select("digest", "node", "id", "copies", F.coalesce("label", "node").alias("label")),
        "classes",
    )
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("best")
    classes = of_text.groupBy("label").agg(best, F.sum("copies").alias("size"))
    answer = of_text.join(classes, "label").select("digest", F.col("best.id").alias("class_id"), F.col("best.node").alias("keeper"), "size")
    return rows.select("row", "id", "digest").join(answer, "digest").select(
        F.col("id").alias(id_col), "class_id", F.col("size").alias("class_size"), (F.col("row") == F.col("keeper")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_md5"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the smallest id, with all its columns.

    Rows are found again by id and text; of rows that repeat both, one stays.
    """
    names = docs.columns
    found = near_duplicates(docs, id_col, text_col, threshold)
    stay = found.where("kept").select(F.col(id_col).alias("stay_id"), F.col("text_md5").alias("stay_md5"))
    marked = docs.withColumn("shelfwatch_mark", F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    same = marked[id_col].eqNullSafe(stay["stay_id"]) & (marked["shelfwatch_mark"] == stay["stay_md5"])
    return marked.join(stay, same, "left_semi").dropDuplicates([id_col, "shelfwatch_mark"]).select(*names)


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, five-word shingles, similarity 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_minhash_near_dedup": op3_minhash_near_dedup}
ORACLES: dict[str, str] = {}

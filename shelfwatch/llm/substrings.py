"""Substring dedup with fixed-block anchors.

Removes every word in a window of ``window`` words whose word sequence also
starts in a document with a smaller id. Any such window holds a whole block of
``block = (window + 1) // 2`` words that begins at a multiple of ``block`` in the
other document. So:

1. Index and probe. Each document's blocks are indexed, and the rolling window
   of ``block`` words at every place probes the index. An anchor is a value that
   is a block of one document and stands in another.
2. Extend. Around anchors only, on either side, every window of ``window`` words
   is met with its equals in other documents; the least id wins. Windows that
   overlap join to maximal repeats, and their words go.

Anchors only choose candidates, so a collision of their hashes costs a little
work. Windows are compared by 80 bits of two independent hashes.

Documents are dealt once, by a hash of their id, in chunks of a few megabytes;
Spark reuses that exchange in all three passes. What a chunk sends is one entry
for each distinct value, sorted and packed, however often a passage occurs in
it, and what comes back is one bit for each entry in the same order. So a
passage that a third of all documents share is one entry a chunk, no pairs of
documents are ever formed, and all moves grow with the text.

Defined cases: a null text has no words; ids are whole numbers, a null id counts
as greater than all others; rows with equal ids do not remove each other's
words, nor does a document its own; documents shorter than a window stay whole;
an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfwatch.llm import words as W

WINDOW = 13
CHUNK_BYTES = 4 << 20
SLICE_ENTRIES = 2_000_000
GREATEST = (1 << 63) - 1

ANCHORS = "slice int, chunk int, body binary, flags binary"
WINDOWS = "slice int, chunk int, body binary, second binary, least binary"
ANSWERS = "chunk int, step int, slice int, n int, bits binary"


class Chunk:
    """The documents of one chunk, least id first, with the hashes of their words."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by("key").combine_chunks()
        self.key = np.asarray(self.table["key"])
        hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in W.pieces(self.table["body"]):
            words = W.split(data, offsets, W.NON_SPACE)
            hashes.append(words.hash)
            sizes.append(np.diff(words.first))
        self.hash, self.size = np.concatenate(hashes), np.concatenate(sizes)
        self.owner = np.repeat(np.arange(len(self.size)), self.size)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def anchors(self, window: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, value) of the rolling blocks of all documents that have a window."""
        block = (window + 1) // 2
        value = W.windows(self.hash, block)
        place = np.flatnonzero(
            (self.owner[: len(value)] == self.owner[block - 1 :][: len(value)]) & (self.size[self.owner[: len(value)]] >= window)
        )
        return place, value[place] >> np.uint64(64 - bits)

    def candidates(self, window: int, place: np.ndarray) -> np.ndarray:
        """Starts of windows that hold an anchor at one of ``place``."""
        block, n = (window + 1) // 2, max(len(self.hash) - window + 1, 0)
        near = np.zeros(len(self.hash) + 1, np.int32)
        np.add.at(near, np.maximum(place - (window - block), 0), 1)
        np.add.at(near, place + 1, -1)
        start = np.flatnonzero(np.cumsum(near)[:n] > 0)
        return start[self.owner[start] == self.owner[start + window - 1]]

    def windows(self, window: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows at ``start``."""
        first = W.windows(self.hash, window)[start]
        second = W.windows(W.mix(self.hash ^ np.uint64(0xA5A5A5A55A5A5A5A)), window)[start]
        return first, (second >> np.uint64(48)).astype(np.uint16)


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each distinct value in that order, entry of each element) of parallel keys."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        ordered = key[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), entry


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(body: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(body) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def pack_rising(values: np.ndarray) -> bytes:
    """Sorted values: a byte for the width of the steps, then the steps."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + pack(steps, width)


def unpack_rising(body: bytes) -> np.ndarray:
    return np.cumsum(unpack(body[1:], body[0]), dtype=np.uint64)


def by_slice(value: np.ndarray, bits: int, slice_bits: int) -> list[tuple[int, slice]]:
    """The runs of sorted values that share their highest ``slice_bits`` of ``bits``."""
    edges = np.searchsorted(value >> np.uint64(bits - slice_bits), np.arange((1 << slice_bits) + 1, dtype=np.uint64))
    return [(k, slice(int(a), int(b))) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]


def answer_bits(answers: pa.Table, step: int) -> np.ndarray:
    """The answers to all entries of a chunk, in the order in which they were sent."""
    rows = sorted(
        (s, n, b) for s, n, b, k in zip(*(answers[c].to_pylist() for c in ("slice", "n", "bits", "step"))) if k == step
    )
    parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for _, n, b in rows]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _send_anchors(window: int, bits: int, slice_bits: int):
    block = (window + 1) // 2

    def run(table: pa.Table) -> pa.Table:
        W.tidy()
        chunk = Chunk(table)
        place, value = chunk.anchors(window, bits)
        order, at, entry = distinct(value)
        owner = chunk.owner[place]
        last = np.append(at[1:], len(order)) - 1
        several = owner[order[at]] != owner[order[last]] if len(order) else np.zeros(0, bool)
        indexed = np.zeros(len(at), bool)
        indexed[entry[(place - chunk.first[owner]) % block == 0]] = True
        value = value[order[at]]
        low = value & np.uint64((1 << (bits - slice_bits)) - 1)
        rows = [
            (k, pack_rising(low[s]), np.packbits(np.concatenate([indexed[s], several[s]])).tobytes())
            for k, s in by_slice(value, bits, slice_bits)
        ]
        number = table["chunk"][0].as_py()
        return pa.table(
            {
                "slice": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([number] * len(rows), pa.int32()),
                "body": pa.array([r[1] for r in rows], pa.binary()), "flags": pa.array([r[2] for r in rows], pa.binary()),
            }
        )

    return run


def _answers(step: int, table: pa.Table, sizes: np.ndarray, yes: np.ndarray) -> pa.Table:
    edges = np.concatenate([[0], np.cumsum(sizes)])
    return pa.table(
        {
            "chunk": table["chunk"].combine_chunks(), "step": pa.array([step] * len(sizes), pa.int32()),
            "slice": table["slice"].combine_chunks(), "n": pa.array(sizes.astype(np.int32)),
            "bits": pa.array([np.packbits(yes[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
        }
    )


def _meet_anchors(table: pa.Table) -> pa.Table:
    """A value is an anchor if it is a block somewhere and stands in more than one document."""
    parts = [unpack_rising(b) for b in table["body"].to_pylist()]
    sizes = np.array([len(p) for p in parts])
    flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=2 * len(p)) for f, p in zip(table["flags"].to_pylist(), parts)]
    indexed = np.concatenate([f[: len(f) // 2] for f in flags])
    several = np.concatenate([f[len(f) // 2 :] for f in flags])
    order, at, entry = distinct(np.concatenate(parts))
    many = np.diff(np.append(at, len(order))) > 1
    anchor = np.logical_or.reduceat(indexed[order], at) & (many | np.logical_or.reduceat(several[order], at))
    return _answers(1, table, sizes, anchor[entry])


def _anchored(chunk: Chunk, answers: pa.Table, window: int, bits: int) -> np.ndarray:
    """Starts of the windows that hold an anchor."""
    place, value = chunk.anchors(window, bits)
    _, _, entry = distinct(value)
    return chunk.candidates(window, place[answer_bits(answers, 1)[entry]])


def _entries(chunk: Chunk, start: np.ndarray, window: int):
    """Distinct windows at ``start``: both hashes, the least id, and the entry of each start."""
    first, second = chunk.windows(window, start)
    order, at, entry = distinct(first, second)
    head = order[at]  # documents are sorted, so the first is the least
    return first[head], second[head], chunk.key[chunk.owner[start[head]]], entry


def _send_windows(window: int, bits: int, slice_bits: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        W.tidy()
        rows, number = [], 0
        if table.num_rows and answers.num_rows:
            chunk, number = Chunk(table), table["chunk"][0].as_py()
            first, second, least, _ = _entries(chunk, _anchored(chunk, answers, window, bits), window)
            least = least.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)  # unsigned, in the same order
            for k, s in by_slice(first, 64, slice_bits):
                body = pack_rising(first[s] & np.uint64((1 << (64 - slice_bits)) - 1))
                base = least[s].min()
                step = least[s] - base
                width = max(1, (int(step.max()).bit_length() + 7) // 8)
                rows.append((k, body, second[s].tobytes(), bytes([width]) + int(base).to_bytes(8, "little") + pack(step, width)))
        return pa.table(
            {
                "slice": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([number] * len(rows), pa.int32()),
                "body": pa.array([r[1] for r in rows], pa.binary()), "second": pa.array([r[2] for r in rows], pa.binary()),
                "least": pa.array([r[3] for r in rows], pa.binary()),
            }
        )

    return run


def _meet_windows(table: pa.Table) -> pa.Table:
    """Whether a smaller id than the chunk's own least has the window."""
    first = [unpack_rising(b) for b in table["body"].to_pylist()]
    sizes = np.array([len(p) for p in first])
    second = np.concatenate([np.frombuffer(b, np.uint16) for b in table["second"].to_pylist()])
    least = np.concatenate(
        [unpack(b[9:], b[0]) + np.uint64(int.from_bytes(b[1:9], "little")) for b in table["least"].to_pylist()]
    )
    order, at, entry = distinct(np.concatenate(first), second)
    best = np.minimum.reduceat(least[order], at)
    return _answers(2, table, sizes, best[entry] < least)


def _finish(window: int, bits: int, kind: pa.DataType):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        W.tidy()
        out = {"id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "spans": []}
        if table.num_rows:
            chunk = Chunk(table)
            gone = np.zeros(len(chunk.hash), bool)
            if answers.num_rows:
                start = _anchored(chunk, answers, window, bits)
                _, _, least, entry = _entries(chunk, start, window)
                known = answer_bits(answers, 2)
                again = known[entry] | (chunk.key[chunk.owner[start]] > least[entry])
                gone = W.covered(start[again], window, len(gone))
            out["id"] = chunk.table["id"]
            out["n_words"] = chunk.size
            out["n_removed"] = W.per_text(gone, chunk.first)
            word = 0
            for _, _, data, offsets in W.pieces(chunk.table["body"]):
                words = W.split(data, offsets, W.NON_SPACE)
                away = gone[word : word + len(words.start)]
                word += len(words.start)
                out["kept_sha256"] += [hashlib.sha256(x).hexdigest() for x in kept_bytes(words, ~away)]
                out["spans"] += spans(away, words.first)
        return pa.table(
            {
                "id": out["id"] if table.num_rows else pa.array([], kind),
                "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()),
                "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
                "removed": pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )

    return run


def kept_bytes(words: W.Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    data, n = words.data.copy(), len(words.data)
    step = np.zeros(n + 1, np.int8)
    step[words.start[keep]] += 1
    step[words.end[keep]] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    kept, owner = np.flatnonzero(keep), words.owner()
    joint = words.end[kept[:-1][owner[kept[:-1]] == owner[kept[1:]]]]  # the space after a word that another follows
    data[joint] = 32
    inside[joint] = True
    body = data[inside].tobytes()
    edges = np.concatenate([[0], np.cumsum(inside)])[words.text_start].tolist()
    return [body[a:b] for a, b in zip(edges[:-1], edges[1:])]


def spans(gone: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """Runs of removed words of each text: first word, word after the last."""
    out: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    edge = np.ones(len(gone), bool)
    edge[1:] = (gone[1:] != gone[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(edge)
    finish = np.append(begin[1:], len(gone))
    for a, b in zip(begin[gone[begin]].tolist(), finish[gone[begin]].tolist()):
        text = int(owner[a])
        out[text].append({"start": a - int(first[text]), "end": b - int(first[text])})
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    chunk_bytes: int = CHUNK_BYTES, slice_entries: int = SLICE_ENTRIES,
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 (of the kept words,
    joined by one space) and removed (spans of words)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(body)).alias("n")).first()["n"] or 0
    chunks = max(math.ceil(total / chunk_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    slice_bits = max(0, math.ceil(math.log2(max(total / 6 / slice_entries, 1))))
    bits = min(32 + slice_bits, 64)
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(GREATEST))
    dealt = docs.select(
        F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int").alias("chunk"), key.alias("key"),
        F.col(id_col).alias("id"), body.alias("body"),
    ).repartition(chunks, "chunk")
    anchors = dealt.groupBy("chunk").applyInArrow(_send_anchors(window, bits, slice_bits), ANCHORS)
    first = anchors.groupBy("slice").applyInArrow(_meet_anchors, ANSWERS)
    sent = dealt.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(
        _send_windows(window, bits, slice_bits), WINDOWS
    )
    second = sent.groupBy("slice").applyInArrow(_meet_windows, ANSWERS)
    kind = docs.schema[id_col].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
    found = dealt.groupBy("chunk").cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(
        _finish(window, bits, arrow),
        f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>",
    )
    return found.withColumnRenamed("id", id_col)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, windows of 13 words."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")


SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
    SELECT doc_id, i, hash(array_to_string(w[i : i + 12], ' ')) AS h, md5(array_to_string(w[i : i + 12], ' ')) AS body
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), least AS (SELECT h, body, min(doc_id) AS first_id FROM places GROUP BY h, body HAVING count(*) > 1
), gone AS (
    SELECT doc_id, list(DISTINCT p) AS ps FROM (
        SELECT doc_id, unnest(range(i, i + 13)) AS p FROM places JOIN least USING (h, body) WHERE first_id < doc_id
    ) GROUP BY doc_id
), kept AS (
    SELECT words.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
        CASE WHEN ps IS NULL THEN w
            ELSE list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(ps, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) END AS k
    FROM words LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""

QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES = {"op2_substring_dedup": SQL}

"""Best-fit packing of documents into fixed-length token sequences.

A document is its token ids and one end id. Longer ones than a sequence are cut
into full pieces, the first of which may be shorter. Pieces are packed by length
only, so the packing works on the number of pieces of each length, at most
``capacity`` numbers whatever the table's size:

1. Martello-Toth dominance reduction. A set of pieces that dominates every other
   set a piece could be in is fixed for good: a piece that nothing fits beside, a
   pair that fills a sequence exactly, or the longest partner where that is as
   good as any other filling. The fixed pieces leave the instance.
2. Best fit, longest first, on what remains. Sequences with equal contents are
   one class with a count, so a step moves a whole class at once.

The plan says which ranks of which length go where. Pieces are ranked within
their length in parts (``numbering``), so a length that a third of all pieces
share is no single task, and find their place in the broadcast plan, which has
at most a few entries for each length.

Defined cases: a null text counts as empty, whose ids are the end id alone;
repeated rows are packed one by one; an empty table gives an empty result. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfwatch.llm import words as W
from shelfwatch.llm.numbering import number_within
from shelfwatch.session import materialise

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"

# Characters on which the two tokenizer libraries split alike; other texts take the slower one.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ſ]")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to ids (uint32) for a byte-level BPE file of ``tokenizers``.

    ``tiktoken`` gives the same ids from the same vocabulary in a quarter of the
    time. Texts with characters beyond Latin scripts or with a special token's
    string are encoded by ``tokenizers`` itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec["added_tokens"]}
    # The file writes bytes as printable characters: printable Latin-1 bytes stand for themselves.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    ranks = {
        bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special
    }
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if PLAIN.search(text) or any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        try:
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except ValueError:  # its pattern gives up on very long runs of blanks
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than a sequence."""
    first = n - (-(-n // capacity) - 1) * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _tokenise(path: str | None, capacity: int):
    @W.tidied
    def run(batches):
        import public_tokenizers

        try:
            encode = encoder(path or public_tokenizers.path(TOKENIZER))
            for batch in batches:
                source, piece, start, length, crc = [], [], [], [], []
                for k, text in enumerate(batch.column(2)):
                    ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                    for number, (at, size) in enumerate(cut(len(ids), capacity)):
                        source.append(k)
                        piece.append(number)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(ids[at : at + size].tobytes()))
                source = pa.array(source, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(source), batch.column(1).take(source), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    names=["row", "id", "piece", "start", "length", "crc"],
                )
        finally:
            encoder.cache_clear()  # each task has its own

    return run


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix the sets that dominate; returns (lengths, times) and lowers ``counts``."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    lengths = sorted(counts)

    def fix(items: tuple[int, ...], times: int) -> None:
        fixed.append((items, times))
        for size in items:
            counts[size] -= times
            if not counts[size]:
                del counts[size], lengths[bisect_left(lengths, size)]

    def smallest(without: int, n: int) -> list[int]:
        """The n smallest lengths left if one piece of ``without`` is taken out."""
        out: list[int] = []
        for size in lengths:
            out += [size] * min(n - len(out), counts[size] - (size == without))
            if len(out) == n:
                break
        return out

    changed = True
    while changed:
        changed = False
        for size in reversed(lengths[:]):
            while counts.get(size, 0):
                room = capacity - size
                least = smallest(size, 3)
                if not least or least[0] > room:  # nothing fits beside it
                    fix((size,), counts[size])
                elif counts.get(room, 0) > (room == size):  # an exact pair beats any other filling
                    fix((size, room), counts[size] // 2 if room == size else min(counts[size], counts[room]))
                else:
                    other = lengths[bisect_right(lengths, room) - 1]
                    if other == size and counts[size] == 1:
                        other = lengths[bisect_left(lengths, size) - 1]
                    single = len(least) < 2 or least[0] + least[1] > room
                    if not single and (len(least) < 3 or sum(least) > room):
                        single = other >= best_pair(lengths, counts, size, room)
                    if not single:
                        break
                    fix((size, other), counts[size] // 2 if other == size else min(counts[size], counts[other]))
                changed = True
    return fixed


def best_pair(lengths: list[int], counts: dict[int, int], without: int, room: int) -> int:
    """The greatest sum of two pieces that is at most ``room``, with one of ``without`` taken out."""
    left = {n: counts[n] - (n == without) for n in lengths if n < room and counts[n] > (n == without)}
    sizes, best = sorted(left), 0
    low, high = 0, len(sizes) - 1
    while low <= high:
        total = sizes[low] + sizes[high]
        if total > room or low == high and left[sizes[low]] < 2:
            high -= 1
        else:
            best = max(best, total)
            low += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first: (lengths, number of sequences) of each class."""
    classes: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, items: tuple[int, ...], times: int) -> None:
        if not classes[room]:
            insort(rooms, room)
        classes[room].append((items, times))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):  # new sequences, each filled with this length
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * size, (size,) * each, full)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[at]
            items, times = classes[room].pop()
            taken = min(left, times)
            if taken < times:
                classes[room].append((items, times - taken))
            if not classes[room]:
                rooms.pop(at)
            put(room - size, (*items, size), taken)
            left -= taken
    return [c for room in sorted(classes) for c in classes[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the ranks of each length go, as parallel arrays sorted by (length, rank)."""
    left = dict(counts)
    patterns = reduce_dominated(left, capacity) + best_fit(left, capacity)
    next_rank: dict[int, int] = defaultdict(int)
    entries, sequence = [], 0
    for items, times in patterns:
        offset = 0
        for size in items:
            entries.append((size, next_rank[size], sequence, offset))
            next_rank[size] += times
            offset += size
        sequence += times
    entries.sort()
    columns = np.array(entries, dtype=np.int64).reshape(-1, 4)
    return {
        "key": (columns[:, 0] << 44) + columns[:, 1], "rank": columns[:, 1],
        "sequence": columns[:, 2], "offset": columns[:, 3],
    }


def _place(sent):
    @W.tidied
    def run(batches):
        where = sent.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.names.index(c))) for c in ("length", "rank"))
            at = np.searchsorted(where["key"], (length << 44) + rank, "right") - 1
            sequence = where["sequence"][at] + rank - where["rank"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(where["offset"][at])],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    tokenizer: str | None = None,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id and offset.

    ``tokenizer`` is the path of a byte-level BPE file, the same on all executors.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("body")
    )
    pieces = materialise(
        source.mapInArrow(
            _tokenise(tokenizer, capacity),
            f"row bigint, id {kind}, piece int, start bigint, length bigint, crc bigint",
        ),
        "pieces",
    )
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    ranked = number_within(pieces, ["length"], ["row", "piece"], "rank").select(
        "id", "piece", "start", "length", "crc", "rank"
    )
    placed = ranked.mapInArrow(
        _place(where), f"id {kind}, piece int, start bigint, length bigint, crc bigint, sequence_id bigint, offset bigint"
    )
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset"
    )


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLES: dict[str, str] = {}

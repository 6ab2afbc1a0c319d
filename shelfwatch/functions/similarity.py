"""Similarity of vectors and of texts by their pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from .. import constants as K


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null when either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms != 0, F.lit(1.0) - dot(a, b) / norms)


# Characters whose hashes are made in one go, about 60 MB of numbers.
SLICE_CHARS = 1 << 20


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def context_prints(texts: pa.Array) -> pa.Array:
    """Winnowed hashes of a text's runs of eight characters, distinct and sorted.

    Every four consecutive runs give their least hash, so two texts that share eleven
    characters in a row share a print. A shorter text is one run, a text of fewer
    than four runs one window; an empty text has no print, null has no list. Hashes
    have 31 bits: two pages of a thousand prints share one by chance once in two
    thousand pairs.
    """
    return _by_slices(texts, _winnow, np.int32)


# One odd factor for every place of a piece; sums of products wrap at 2^64.
_PIECE_FACTORS = np.random.default_rng(8).integers(2**63, size=K.CONTEXT_PIECE_CHARS, dtype=np.uint64) * 2 + 1


@F.arrow_udf(T.ArrayType(T.LongType()))
def context_pieces(texts: pa.Array) -> pa.Array:
    """Hashes of all distinct runs of eight characters, sorted.

    A shorter text is one run, an empty text has none, null has no list. Hashes
    have 64 bits.
    """
    return _by_slices(texts, _pieces, np.int64)


def _by_slices(texts: pa.Array, hashes, kind: type) -> pa.Array:
    parts, sizes, rows, held = [np.zeros(0, kind)], [np.zeros(0, np.int64)], [], 0
    for text in texts:
        rows.append(text.as_py() or "")
        held += len(rows[-1])
        if held >= SLICE_CHARS:
            found, n = hashes(rows)
            parts.append(found), sizes.append(n)
            rows, held = [], 0
    if rows:
        found, n = hashes(rows)
        parts.append(found), sizes.append(n)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    missing = np.append(np.asarray(texts.is_null()), False)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=missing), pa.array(np.concatenate(parts)))


def _pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of all texts one after another, and how many each has."""
    size = K.CONTEXT_PIECE_CHARS
    chars = np.array([len(t) for t in texts])
    width = chars + size - 1  # zeros after every text: no run reaches the next one
    codes = np.zeros(width.sum(), np.uint64)
    given = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), width)
    place = np.arange(len(codes)) - (np.cumsum(width) - width)[owner]
    codes[place < chars[owner]] = given + np.uint64(1)  # no character is like the zeros
    runs = np.zeros(len(codes) - size + 1, np.uint64)
    for j, factor in enumerate(_PIECE_FACTORS):
        runs += codes[j : j + len(runs)] * factor
    starts = place[: len(runs)] < np.where(chars > 0, np.maximum(chars - size + 1, 1), 0)[owner[: len(runs)]]
    runs, owner = runs[starts].view(np.int64), owner[: len(runs)][starts]
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.append(True, (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1]))[: len(runs)]
    return runs[new], np.bincount(owner[new], minlength=len(texts))


def _winnow(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The prints of all texts one after another, and how many each has."""
    size, window = K.CONTEXT_PIECE_CHARS, K.CONTEXT_WINDOW_PIECES
    apart = size - 1 + window  # zeros after every text: no run or window reaches the next one
    chars = np.array([len(t) for t in texts])
    joined = "".join(t + "\0" * apart for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    last = len(codes) - size + 1
    weights = [pow(K.PIECE_BASE, size - 1 - j, K.PIECE_PRIME) for j in range(size)]
    runs = sum(codes[j : last + j] * w for j, w in enumerate(weights)) % K.PIECE_PRIME
    owner = np.repeat(np.arange(len(texts)), chars + apart)[:last]
    place = np.arange(last) - (np.cumsum(chars + apart) - chars - apart)[owner]
    n_runs = np.where(chars > 0, np.maximum(chars - size + 1, 1), 0)
    runs[place >= n_runs[owner]] = K.PIECE_PRIME  # above every hash
    least = np.lib.stride_tricks.sliding_window_view(runs, window).min(axis=1)
    n_windows = np.maximum(n_runs - window + 1, np.minimum(n_runs, 1))
    chosen = place[: len(least)] < n_windows[owner[: len(least)]]
    keys = np.sort((owner[: len(least)][chosen] << 31) | least[chosen])
    keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
    return (keys & (2**31 - 1)).astype(np.int32), np.bincount(keys >> 31, minlength=len(texts))


def print_similarity(previous: Column, current: Column) -> Column:
    """Shared prints over the mean number of prints: 1 for equal sets (two empty ones too), 0 for none."""
    total = F.size(previous) + F.size(current)
    shared = F.size(F.array_intersect(previous, current))
    return F.when(previous.isNotNull() & current.isNotNull(), F.when(total == 0, 1.0).otherwise(2 * shared / total))

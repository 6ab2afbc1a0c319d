"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts.

Each class, toxic and plain, has a model of words given the word before:

- pairs of words with absolute discounting; what the discount sets free goes to
- the class's own words, spelt in steps (their first 4 bytes, first 6 bytes, the
  whole word, each given the step before), so a new form of a known stem is
  recognised; what discounting sets free there goes to
- Kneser-Ney's continuation counts, which both classes share: the number of
  distinct words that stand before a word, over all documents, labelled or not.

So a rare expression that neither class has seen says little, one that only one
class uses says much, and two harmless words may make a toxic pair.

A toxic text is mostly ordinary words, so it is taken as a mixture: a ``SHARE``
of its words comes from the toxic model, the others from the ordinary one. A
text's score is the length-normalised difference of its log-likelihoods under
that mixture and under the ordinary model, turned into a probability by a
logistic curve that is fitted on labelled rows the counts have not seen.

The continuation counts need every distinct pair of words of the corpus. A task
sends each pair it has once, packed by word in blobs for units of words and of a
quarter of the words before, so a word that stands everywhere is many tasks' work;
the units take out the pairs that several tasks sent and count the rest. This
grows with the corpus and stays in Spark. What is broadcast follows from the
class counts, at most ``sample`` labelled rows (those with the smallest hash of
their id): the steps that these rows hold, collected a step at a time, and the
pairs that follow at least ``CUTOFF`` distinct words in toxic rows (so a passage
that is copied around makes no expression), raised until at most ``PAIRS`` stay,
if they follow their first word more often in one class than chance explains.
For a step that neither class has
seen the difference follows from the step before alone, as the shared counts
cancel, so scoring with these is exact.

Words are known by 64-bit hashes, the words before in pairs of the corpus by 32.

Defined cases: a null or empty text has no words and gets the curve's value for
a difference of 0; of several labels for an id the largest counts, null labels
are ignored; without labels of both classes every score is 0; repeated rows are
scored alike; rows that repeat a labelled id with other texts all count, and tune
the curve by their sums; a null id is not held out. Other columns are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfwatch.llm import words as W
from shelfwatch.llm.quality import fold_of, training_labels
from shelfwatch.session import materialise

STEPS = (4, 6)  # bytes of a word's beginnings; the whole word follows
LEVELS = len(STEPS) + 1
WIDTH = 1 << 20  # distinct pairs a task holds before it sends them
SAMPLE = 200_000
DISCOUNT = 0.75
CUTOFF, PAIRS, SIGMAS = 6, 1 << 22, 4
CHUNK = 4096  # counts in one row
SHARE = 0.02
THRESHOLD = 0.3
TUNE_PARTS = 5  # one part of the labelled rows fits the curve, the others the counts
FIRST = np.uint64(0x5851F42D4C957F2D)  # stands for the word before a text's first
ROOT = np.uint64(0)


class Model(NamedTuple):
    curve: np.ndarray  # weights of (1, difference a word, difference a root of words)
    event: list[np.ndarray]  # for each step: sorted keys that the labelled texts hold
    ratio: list[np.ndarray]  # log-likelihood difference of each given the step before
    before: list[np.ndarray]  # sorted keys of the steps before them
    other: list[np.ndarray]  # difference of any other step after each of those
    pair: np.ndarray  # sorted keys of the kept pairs
    pair_ratio: np.ndarray
    context: np.ndarray  # sorted words before that have kept pairs
    context_ratio: np.ndarray  # difference of what these leave to other words


def probability(total: np.ndarray, words: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(inputs(total, words) @ curve, -30, 30)))


def inputs(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the curve sees: the difference for each word, and with the noise of short texts taken off."""
    n = np.maximum(words, 1)
    return np.column_stack([np.ones(len(n)), 10 * total / n, total / np.sqrt(n)])


class Distinct(NamedTuple):
    """The distinct words of some texts."""

    hash: np.ndarray
    stem: np.ndarray  # first six bytes as a number, the first byte lowest
    number: np.ndarray  # of each token: its word
    previous: np.ndarray  # of each token: hash of the word before


def distinct(words: W.Words) -> Distinct:
    order = np.argsort(words.hash)
    new = np.append(True, np.diff(words.hash[order]) != 0)[: len(order)]
    at, number = order[new], np.empty(len(order), np.int64)  # any place of a word will do: its bytes are the same
    number[order] = np.cumsum(new) - 1
    hashes = words.hash[at]
    start, end = words.start[at], words.end[at]
    stem = np.zeros(len(at), np.uint64)
    for k in range(STEPS[-1]):
        byte = words.data[np.minimum(start + k, len(words.data) - 1)].astype(np.uint64)
        stem |= np.where(start + k < end, byte, 0).astype(np.uint64) << np.uint64(8 * k)
    previous = np.concatenate([[FIRST], words.hash[:-1]]).astype(np.uint64)[: len(words.hash)]
    begins = words.first[:-1][np.diff(words.first) > 0]
    previous[begins] = FIRST
    return Distinct(hashes, stem, number, previous)


def steps_of(hashes: np.ndarray, stem: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each step of each word: its key, the key before, and whether the word had not ended before."""
    keys = [stem & np.uint64((1 << (8 * k)) - 1) for k in STEPS] + [hashes]
    befores = [np.zeros(len(stem), np.uint64), *keys[:-1]]
    open_ = [np.ones(len(stem), bool)] + [stem >> np.uint64(8 * (k - 1)) > 0 for k in STEPS]
    return list(zip(keys, befores, open_))


def pair_key(previous: np.ndarray, word: np.ndarray) -> np.ndarray:
    return W.mix(previous * np.uint64(W.BASE) + word)


# --- counts -----------------------------------------------------------------


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Words with stem and tokens of both classes, and distinct codes (number of the word, short hash before)."""
    hashes, stems, toxic, plain = (np.concatenate(c) for c in list(zip(*parts))[:4])
    hashes, at = np.unique(hashes, return_inverse=True)
    codes, done = [], 0
    for p in parts:
        place = at[done : done + len(p[0])].astype(np.uint64)
        codes.append(place[(p[4] >> np.uint64(32)).astype(np.int64)] << np.uint64(32) | p[4] & np.uint64(0xFFFFFFFF))
        done += len(p[0])
    sums = [np.bincount(at, c, len(hashes)).astype(np.int64) for c in (toxic, plain)]
    stem = np.zeros(len(hashes), np.uint64)
    np.maximum.at(stem, at, stems)
    return hashes, stem, *sums, W.unique(np.concatenate(codes))


def _blobs(merged: tuple[np.ndarray, ...], units: int):
    """Rows (unit, words, distinct words before, pairs, their packed columns) of a task's words.

    The columns: words, stems, tokens of both classes, number of pairs, distinct words before, each pair's
    place among these. Words and words before are sorted; what is sent is how far each lies from the last.
    """
    hashes, stems, toxic, plain, codes = merged
    number, before = (codes >> np.uint64(32)).astype(np.int64), codes & np.uint64(0xFFFFFFFF)
    unit = (hashes[number] % np.uint64(units)).astype(np.int64) * 4 + (before >> np.uint64(30)).astype(np.int64)
    order = np.lexsort((codes, unit))
    unit, number, before = unit[order], number[order], before[order].astype(np.uint32)
    new = np.flatnonzero((np.diff(unit, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0))
    size = np.diff(np.append(new, len(unit)))
    word, at = number[new], unit[new]
    # stem and tokens go with the first unit that has the word
    once = np.zeros(len(word), bool)
    once[np.unique(word, return_index=True)[1]] = True
    columns = [hashes[word], *(np.where(once, c[word], 0) for c in (stems, toxic, plain)), size]
    edges = np.flatnonzero(np.diff(at, prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(at))):
        low = new[a]
        high = new[b] if b < len(new) else len(before)
        seen, place = np.unique(before[low:high], return_inverse=True)
        steps = np.diff(columns[0][a:b], prepend=np.uint64(0)), np.diff(seen, prepend=np.uint32(0))
        packed = _packed([steps[0], *(c[a:b].astype(np.int64) for c in columns[1:]), steps[1], place.astype(np.uint32)])
        yield int(at[a]), int(b - a), len(seen), int(high - low), packed


def _packed(columns: list[np.ndarray]) -> bytes:
    """The columns' bytes, those of one place in the numbers together, compressed."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, words: int, befores: int, pairs: int) -> list[np.ndarray]:
    raw = pa.decompress(blob, 40 * words + 4 * befores + 4 * pairs, codec="zstd", asbytes=True)
    parts = [(k * 8 * words, 8, words, np.int64) for k in range(5)]
    parts += [(40 * words, 4, befores, np.uint32), (40 * words + 4 * befores, 4, pairs, np.uint32)]
    out = []
    for start, width, n, kind in parts:
        planes = np.frombuffer(raw, np.uint8, width * n, start).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
    return [np.cumsum(out[0].view(np.uint64)), *out[1:5], np.cumsum(out[5], dtype=np.uint32)[out[6]]]


BLOBS = "unit bigint, words bigint, befores bigint, pairs bigint, packed binary"


def _sent(parts, units: int):
    if parts:
        names = [c.split()[0] for c in BLOBS.split(", ")]
        rows = list(_blobs(_merged(parts), units))
        for k in range(0, len(rows), 64):
            columns = list(zip(*rows[k : k + 64]))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=names
            )


def _gather(units: int):
    """Distinct pairs of words of a task, and its words' tokens in labelled texts."""

    @W.tidied
    def run(batches):
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            label = np.asarray(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False))
            for row, stop, data, offsets in W.pieces(batch.column(1)):
                words = W.split(data, offsets, W.LETTERS)
                if not len(words.hash):
                    continue
                found, kind = distinct(words), label[row:stop][words.owner()]
                sums = [np.bincount(found.number[kind == one], minlength=len(found.hash)) for one in (1, 0)]
                codes = found.number.astype(np.uint64) << np.uint64(32) | W.mix(found.previous) >> np.uint64(32)
                parts.append((found.hash, found.stem, *sums, W.unique(codes)))
                if sum(len(p[4]) for p in parts) > 1.25 * WIDTH:
                    parts = [_merged(parts)]
                    if len(parts[0][4]) > WIDTH:
                        yield from _sent(parts, units)
                        parts = []
        yield from _sent(parts, units)

    return run


WORDS = "word bigint, stem bigint, toxic bigint, plain bigint, contexts bigint"


@W.tidied
def _united(batches):
    """What is left of a partition's blobs: distinct pairs counted by word."""
    parts: list[tuple[np.ndarray, ...]] = []

    def rows(merged):
        hashes, stems, toxic, plain, codes = merged
        contexts = np.bincount((codes >> np.uint64(32)).astype(np.int64), minlength=len(hashes))
        columns = [hashes.view(np.int64), stems.view(np.int64), toxic, plain, contexts.astype(np.int64)]
        for k in range(0, len(hashes), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[k : k + 50_000]) for c in columns], names=[c.split()[0] for c in WORDS.split(", ")]
            )

    for batch in batches:
        for n, befores, pairs, blob in zip(*(c.to_pylist() for c in batch.columns[1:])):
            hashes, stems, toxic, plain, sizes, before = _unpacked(blob, n, befores, pairs)
            number = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            codes = number << np.uint64(32) | before.astype(np.uint64)
            parts.append((hashes, stems.view(np.uint64), toxic, plain, codes))
            if sum(len(p[4]) for p in parts) > max(WIDTH, 2 * len(parts[0][4])):
                parts = [_merged(parts)]
    if parts:
        yield from rows(_merged(parts))


def count_words(texts: DataFrame) -> DataFrame:
    """Of every word of the texts (label, body): stem, tokens of either class, distinct words before it."""
    units = max(64, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = [F.sum(c).alias(c) for c in ("toxic", "plain", "contexts")]
    sent = texts.mapInArrow(_gather(units), BLOBS).repartition("unit")
    return sent.mapInArrow(_united, WORDS).groupBy("word").agg(F.max("stem").alias("stem"), *sums)


def _pairs_of(column):
    """Pairs (word before, word) of the texts, piece by piece, with their keys and the word before the pair."""
    for _, _, data, offsets in W.pieces(column):
        words = W.split(data, offsets, W.LETTERS)
        if len(words.hash):
            found = distinct(words)
            second = found.previous != FIRST
            ahead = np.where(second, np.concatenate([[FIRST], found.previous[:-1]]), FIRST).astype(np.uint64)
            yield pair_key(found.previous, words.hash), found.previous, words.hash, found.stem[found.number], ahead


PAIR = ["pair", "previous", "word", "stem", "ahead"]


@W.tidied
def _count_pairs(batches):
    for batch in batches:
        for columns in _pairs_of(batch.column(0)):
            _, at = np.unique(pair_key(columns[4], columns[0]), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(c[at].view(np.int64)) for c in columns], names=PAIR)


def _count_known(sent):
    """Tokens of known pairs and of the words before them."""

    @W.tidied
    def run(batches):
        pairs, contexts = sent.value
        tokens, seen = np.zeros(len(pairs), np.int64), np.zeros(len(contexts), np.int64)
        for batch in batches:
            for key, previous, _, _, _ in _pairs_of(batch.column(0)):
                for known, asked, out in ((pairs, key, tokens), (contexts, previous, seen)):
                    at, there = _place(known, asked)
                    out += np.bincount(at[there], minlength=len(known))
        for kind, n in enumerate((tokens, seen)):
            starts = [k for k in range(0, len(n), CHUNK) if n[k : k + CHUNK].any()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * len(starts), pa.int64()), pa.array(starts, pa.int64()),
                    pa.array([n[k : k + CHUNK].tobytes() for k in starts], pa.binary()),
                ],
                names=["kind", "start", "counts"],
            )

    return run


def _add(table: pa.Table) -> pa.Table:
    """The counts of a chunk, a row a task, added up."""
    total = sum(np.frombuffer(c.as_py(), np.int64) for c in table["counts"])
    return table.slice(0, 1).set_column(2, "counts", pa.array([total.tobytes()], pa.binary()))


# --- models -----------------------------------------------------------------


def ratio_of(before, toxic, plain, contexts, around=None) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods, toxic and plain, of every event of a step given the one before it, a number from 0 on.

    ``around``: contexts of all events after that one, if more than the given ones.
    """
    sum_of = lambda x: np.bincount(before, x)[before]  # noqa: E731  over events with the same one before
    context = np.maximum(contexts, 1e-3)
    shared = context / (sum_of(context) if around is None else around)
    out = []
    for counts in (toxic.astype(float), plain.astype(float)):
        total = sum_of(counts)
        free = np.maximum(sum_of(np.minimum(counts, DISCOUNT)), DISCOUNT)
        chance = (np.maximum(counts - DISCOUNT, 0) + free * shared) / np.maximum(total, DISCOUNT)
        out.append(np.log(np.where(total > 0, chance, shared)))
    return out[0], out[1]


def other_of(before: np.ndarray, toxic: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """The difference of an event neither class has seen, for each event before it: all shared counts cancel."""
    out = np.zeros(before.max(initial=-1) + 1)
    for sign, counts in ((1, toxic.astype(float)), (-1, plain.astype(float))):
        total, free = np.bincount(before, counts), np.bincount(before, np.minimum(counts, DISCOUNT))
        out += sign * np.log(np.where(total > 0, free / np.maximum(total, DISCOUNT), 1))
    return out.astype(np.float32)


def telling(counts, totals) -> np.ndarray:
    """Whether a pair follows its first word more often in one class than chance explains (``SIGMAS``).

    Pairs are picked by their toxic tokens, so without this test the luckiest ones
    of those that both classes use alike would count as toxic.
    """
    both = counts[0] + counts[1]
    expected = both * totals[0] / np.maximum(totals[0] + totals[1], 1)
    return np.abs(counts[0] - expected) > SIGMAS * np.sqrt(expected + 1)


def pair_ratios(previous, word_chance, counts, totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Difference of every kept pair, the words before them, and the difference of what is left there.

    ``word_chance``, ``counts`` and ``totals`` are for (toxic, plain): the chance of the
    second word, the tokens of the pair, the tokens of the word before.
    """
    context, at = np.unique(previous, return_inverse=True)
    ratio, left = np.zeros(len(previous)), np.zeros(len(context))
    for sign, chance, n, total in zip((1, -1), word_chance, counts, totals):
        own = np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)
        rest = np.maximum(1 - np.bincount(at, own, len(context)), 1e-6)
        ratio += sign * np.log(own + rest[at] * chance)
        left += sign * np.log(rest)
    return np.clip(ratio, -60, 60).astype(np.float32), context, left.astype(np.float32)


def fit_curve(x: np.ndarray, label: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Logistic weights by Newton's method."""
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (chance - label) + penalty * weights
        curve = (x * (chance * (1 - chance))[:, None]).T @ x + penalty * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights -= step * min(1, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _place(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key asked for, and whether it is there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _find(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each key asked for, 0 if there is none, and whether there is one."""
    at, there = _place(keys, asked)
    return np.where(there, values[at] if len(keys) else 0.0, 0.0), there


def word_differences(model: Model, hashes: np.ndarray, stem: np.ndarray) -> np.ndarray:
    """Log-likelihood difference of each distinct word by itself."""
    out = np.zeros(len(hashes))
    for level, (event, before, open_) in enumerate(steps_of(hashes, stem)):
        own, there = _find(model.event[level], model.ratio[level], event)
        other = _find(model.before[level], model.other[level], before)[0]
        out += np.where(open_, np.where(there, own, other), 0)
    return out


def _sums(model: Model, column) -> tuple[np.ndarray, np.ndarray]:
    """Summed difference and words of each text."""
    totals, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in W.pieces(column):
        words = W.split(data, offsets, W.LETTERS)
        if len(words.hash) and len(model.event):
            found = distinct(words)
            alone = word_differences(model, found.hash, found.stem)[found.number]
            left = _find(model.context, model.context_ratio, found.previous)[0]
            pair, there = _find(model.pair, model.pair_ratio, pair_key(found.previous, words.hash))
            both = np.where(there, pair, alone + left)
            mixed = np.log1p(SHARE * np.expm1(np.minimum(both, 30)))
        else:
            mixed = np.zeros(len(words.hash))
        totals.append(np.bincount(words.owner(), mixed, len(offsets) - 1))
        counts.append(np.diff(words.first))
    return np.concatenate(totals), np.concatenate(counts)


def _total(sent):
    @W.tidied
    def run(batches):
        for batch in batches:
            total, count = _sums(sent.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(count)], names=["label", "total", "n"])

    return run


def events_of(counts: DataFrame) -> DataFrame:
    """(level, event, before, toxic, plain, contexts) of the steps that labelled texts have; level -1 is the sum of all words."""
    ways = [F.struct(F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("event"), F.lit(0).cast("bigint").alias("before"))]
    before = F.lit(0).cast("bigint")
    for level, size in enumerate(STEPS):
        event = F.col("stem").bitwiseAND(F.lit((1 << (8 * size)) - 1))
        last = STEPS[level - 1] if level else 0
        ways.append(F.when(F.lit(not level) | (F.shiftright("stem", 8 * max(last - 1, 0)) > 0), F.struct(
            F.lit(level).alias("level"), event.alias("event"), before.alias("before"))))
        before = event
    whole = F.struct(F.lit(len(STEPS)).alias("level"), F.col("word").alias("event"), before.alias("before"))
    known = F.col("toxic") + F.col("plain") > 0  # other words only add to the steps before them
    ways.append(F.when(known & (F.shiftright("stem", 8 * (STEPS[-1] - 1)) > 0), whole))
    sums = [F.sum(c).alias(c) for c in ("toxic", "plain", "contexts")]
    each = counts.select(F.explode(F.array_compact(F.array(*ways))).alias("step"), "toxic", "plain", "contexts")
    return each.groupBy("step.level", "step.event").agg(F.min("step.before").alias("before"), *sums).where("toxic + plain > 0")


class Steps(NamedTuple):
    event: np.ndarray
    toxic: np.ndarray  # log-likelihoods from the beginning of the word
    plain: np.ndarray


def _learn(counts: DataFrame) -> tuple[Model | None, list[Steps]]:
    """The differences of the steps that either class has, from the counts of all words."""
    own = materialise(events_of(counts), "class-steps")
    total = own.where("level = -1").select("contexts").collect()
    out: dict[str, list] = {name: [] for name in ("event", "ratio", "before", "other")}
    steps, seen = [Steps(np.array([ROOT]), np.zeros(1), np.zeros(1))], np.zeros(2, np.int64)
    contexts = np.array([total[0][0] if total else 0])
    for level in range(LEVELS):  # one at a time: the driver holds few full tables
        found = own.where(F.col("level") == level).drop("level").toArrow()
        column = {name: found[name].to_numpy() for name in found.column_names}
        order = np.argsort(column["event"].view(np.uint64))
        column = {name: c[order] for name, c in column.items()}
        event, above = column["event"].view(np.uint64), column["before"].view(np.uint64)
        before, at = np.unique(above, return_inverse=True)
        if not level:
            seen += [column["toxic"].sum(), column["plain"].sum()]
        # all words that have a step go on to a next one, so its contexts are those of all its next ones
        around = _find(steps[-1].event, contexts, above)[0]
        toxic, plain = ratio_of(at, column["toxic"], column["plain"], column["contexts"], around)
        contexts = column["contexts"]
        out["event"].append(event)
        out["ratio"].append(np.clip(toxic - plain, -60, 60).astype(np.float32))
        out["before"].append(before)
        out["other"].append(other_of(at, column["toxic"], column["plain"]))
        ahead = [_find(steps[-1].event, values, above)[0] for values in (steps[-1].toxic, steps[-1].plain)]
        steps.append(Steps(event, ahead[0] + toxic, ahead[1] + plain))
    if not seen.all():
        return None, []
    none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    return Model(np.array([0.0, 1.0, 0.0]), **out, pair=none[0], pair_ratio=none[1], context=none[0], context_ratio=none[1]), steps[1:]


def _chances(steps: list[Steps], word: np.ndarray, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each word, which a labelled text has, in either class: that of its last step."""
    toxic, plain = np.zeros(len(word)), np.zeros(len(word))
    for level, (event, _, open_) in enumerate(steps_of(word, stem)):
        own = [_find(steps[level].event, values, event)[0] for values in (steps[level].toxic, steps[level].plain)]
        toxic, plain = np.where(open_, own[0], toxic), np.where(open_, own[1], plain)
    return np.exp(toxic), np.exp(plain)


def _with_pairs(model: Model, steps: list[Steps], texts: DataFrame) -> Model:
    """The model with the pairs of the labelled texts (label, body)."""
    same = [F.min(c).alias(c) for c in PAIR[1:4]]
    toxic = texts.where("label = 1").select("body").mapInArrow(_count_pairs, ", ".join(f"{c} bigint" for c in PAIR))
    toxic = toxic.groupBy("pair", "ahead").agg(*same).groupBy("pair").agg(*same, F.count(F.lit(1)).alias("n"))
    toxic = materialise(toxic.where(F.col("n") >= CUTOFF), "pairs")
    cutoff, kept = CUTOFF, 0
    for row in toxic.groupBy("n").count().orderBy(F.desc("n")).limit(PAIRS).collect():  # a row holds a pair at least
        kept += row["count"]
        if kept > PAIRS:
            cutoff = row["n"] + 1
            break
    found = toxic.where(F.col("n") >= cutoff).orderBy("pair").toArrow()
    pair, previous, word, stem = (found[c].to_numpy().view(np.uint64) for c in ("pair", "previous", "word", "stem"))
    order = np.argsort(pair)
    pair, previous, word, stem = (c[order] for c in (pair, previous, word, stem))
    if not len(pair):
        return model
    contexts = np.unique(previous)
    sent = texts.sparkSession.sparkContext.broadcast((pair, contexts))
    counts, totals = [], []
    for label in (1, 0):
        schema = "kind bigint, start bigint, counts binary"
        known = texts.where(F.col("label") == label).select("body").mapInArrow(_count_known(sent), schema)
        values = np.zeros(len(pair)), np.zeros(len(contexts))
        for kind, start, n in known.groupBy("kind", "start").applyInArrow(_add, schema).collect():
            part = np.frombuffer(n, np.int64)
            values[kind][start : start + len(part)] = part
        counts.append(values[0])
        totals.append(values[1])
    at = np.searchsorted(contexts, previous)
    totals = [t[at] for t in totals]
    own = telling(counts, totals)
    pair, previous, word, stem, counts, totals = pair[own], previous[own], word[own], stem[own], *([x[own] for x in c] for c in (counts, totals))
    ratio, context, left = pair_ratios(previous, _chances(steps, word, stem), counts, totals)
    return model._replace(pair=pair, pair_ratio=ratio, context=context, context_ratio=left)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    label_id_col: str = "doc_id", folds: int = 4, held_out: int = 2, sample: int = SAMPLE,
) -> Model:
    """Both class models and the curve, from labels outside the held-out fold."""
    context = docs.sparkSession.sparkContext
    chosen = training_labels(labels, label_id_col, label_col, folds, held_out, sample)
    tune = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(TUNE_PARTS)) == 0
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    counted, tuning = F.broadcast(chosen.where(~tune)), F.broadcast(chosen.where(tune))
    model, steps = _learn(count_words(texts.join(counted, "id", "left").select("label", "body")))
    if model is None:
        return Model(np.array([-30.0, 0, 0]), [], [], [], [], *[np.zeros(0)] * 4)
    model = _with_pairs(model, steps, texts.join(counted, "id").select("label", "body"))
    sums = texts.join(tuning, "id").select("label", "body")
    sums = sums.mapInArrow(_total(context.broadcast(model)), "label int, total double, n bigint").toArrow()
    sums = sums.sort_by([("label", "ascending"), ("total", "ascending"), ("n", "ascending")])
    label = sums["label"].to_numpy().astype(float)
    if not len(label) or label.min() == label.max():  # too few to tune: even odds at a difference of 0
        return model
    return model._replace(curve=fit_curve(inputs(sums["total"].to_numpy(), sums["n"].to_numpy()), label))


def _score(sent):
    @W.tidied
    def run(batches):
        for batch in batches:
            score = probability(*_sums(sent.value, batch.column(1)), sent.value.curve)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])

    return run


def score_toxicity(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: id, score (0 to 1) and predicted (1 if the score reaches the threshold)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    found = texts.mapInArrow(_score(sent), f"id {kind}, score double")
    return found.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keep(sent, at: int, threshold: float):
    @W.tidied
    def run(batches):
        for batch in batches:
            score = probability(*_sums(sent.value, batch.column(at)), sent.value.curve)
            yield batch.filter(pa.array(score < threshold))

    return run


def drop_toxic(
    docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(sent, docs.columns.index(text_col), threshold), docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, learnt from labels whose id's crc32 modulo 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfwatch.llm import packing
from shelfwatch.llm.numbering import number_within


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def optimum(sizes, capacity):
    sizes, best = sorted(sizes, reverse=True), len(sizes)

    def rec(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for room in sorted(set(b for b in bins if b >= sizes[k])):
            left = list(bins)
            left[left.index(room)] -= sizes[k]
            rec(k + 1, left)
        rec(k + 1, [*bins, capacity - sizes[k]])

    rec(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(2)
    for _ in range(500):
        capacity = rng.choice([8, 20, 50])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
        left = dict(Counter(sizes))
        fixed = packing.reduce_dominated(left, capacity)
        assert all(sum(items) <= capacity for items, _ in fixed)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + optimum(rest, capacity) == optimum(sizes, capacity)
        assert Counter(s for items, n in fixed for s in items for _ in range(n)) + Counter(rest) == Counter(sizes)


def test_plan_places_every_rank_once():
    rng = random.Random(3)
    for _ in range(50):
        counts = dict(Counter(rng.choice([5, 9, 17, 30, rng.randint(1, 100)]) for _ in range(400)))
        where = packing.plan(counts, 100)
        room = defaultdict(list)
        for size, n in counts.items():
            for rank in range(n):
                at = np.searchsorted(where["key"], (size << 44) + rank, "right") - 1
                room[int(where["sequence"][at] + rank - where["rank"][at])].append((int(where["offset"][at]), size))
        for places in room.values():
            places.sort()
            assert [o for o, _ in places] == [sum(s for _, s in places[:k]) for k in range(len(places))]
            assert sum(s for _, s in places) <= 100
        assert len(room) <= -(-sum(s * n for s, n in counts.items()) // 100) * 1.25 + 1


def check(rows, got, tokenizer, capacity):
    texts, pieces = defaultdict(list), defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for r in got:
        pieces[r.doc_id].append(r)
    for i, own in texts.items():
        want = []
        for t in own:
            ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
            first = (len(ids) - 1) % capacity + 1
            cuts = [(0, first)] + [(s, capacity) for s in range(first, len(ids), capacity)]
            want += [(k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(cuts)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i]) == sorted(want)
    room = defaultdict(list)
    for r in got:
        room[r.sequence_id].append((r.offset, r.length))
    for places in room.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    return len(room), sum(r.length for r in got)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_odd_documents(awkward, odd_rows, no_docs, tokenizer, capacity):
    rows = odd_rows + [(600, "a <|endoftext|> b"), (601, "<|endoftext|>")]
    got = packing.pack(awkward(rows), capacity=capacity).collect()
    sequences, total = check(rows, got, tokenizer, capacity)
    assert sequences <= total / capacity * 1.05 + 1
    assert packing.pack(no_docs).count() == 0


def test_whole_table(spark, sf_dir, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    sequences, total = check(rows, packing.op4_best_fit_packing(spark, sf_dir).collect(), tokenizer, 2048)
    assert sequences <= -(-total // 2048) * 1.01 + 1


def test_both_libraries_give_the_same_ids(tokenizer):
    encode, rng = packing.encoder(public_tokenizers.path(packing.TOKENIZER)), random.Random(0)
    kinds = [chr(c) for c in range(0x200)] + list(" \n\t'st'llabé1½") * 20 + ["漢", " ", "́", "😀", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(kinds) for _ in range(rng.randrange(30)))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_numbers_are_gapless(spark):
    rows = spark.createDataFrame([(k % 3 if k % 5 else 0, k) for k in range(500)], "g int, k int")
    got = defaultdict(list)
    for r in number_within(rows, ["g"], ["k"], "no", spread=4).collect():
        got[r.g].append(r.no)
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


@pytest.mark.parametrize("text", [" " * 1_000_000 + "a", "\n" * 1_000_000 + "b c", "a" + "\t " * 500_000, "x" * 1_000_000])
def test_very_long_runs(tokenizer, text):
    encode = packing.encoder(public_tokenizers.path(packing.TOKENIZER))
    assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_task_leaves_no_tokenizer_in_its_worker():
    """Idle workers count as the executor's memory."""
    import pyarrow as pa

    from shelfwatch.llm import packing

    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([7]), pa.array(["some text"])], names=["row", "id", "text"])
    rows = list(packing._tokenise(None, 2048)(iter([batch])))
    assert rows[0].column(1).to_pylist() == [7] and packing.encoder.cache_info().currsize == 0

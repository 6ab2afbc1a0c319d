import random
import zlib
from collections import defaultdict

import pytest

from shelfwatch.llm.sharding import RoomTree, best_fit_decreasing, least_capacity, shard


def naive(sizes, capacity):
    rooms, out = [], []
    for size in sizes:
        fits = [(r, k) for k, r in enumerate(rooms) if r >= size]
        if fits:
            room, box = min(fits)
        else:
            rooms.append(max(capacity, size))
            room, box = rooms[-1], len(rooms) - 1
        rooms[box] = room - size
        out.append(box)
    return out


def test_tree_is_best_fit():
    rng = random.Random(1)
    for _ in range(100):
        sizes = sorted((rng.randint(1, 60) for _ in range(rng.randrange(80))), reverse=True)
        assert best_fit_decreasing(sizes, 70) == naive(sizes, 70)
    tree, rooms = RoomTree(width=4), set()
    for k in range(500):
        room = rng.randrange(300)
        tree.add(room, k)
        rooms.add((room, k))
        if k % 3 == 0:
            size = rng.randrange(300)
            want = min((x for x in rooms if x[0] >= size), default=None)
            assert tree.take_tightest(size) == want
            rooms.discard(want)


def test_no_more_shards_than_asked():
    rng = random.Random(2)
    for n in (0, 1, 3, 50, 400):
        sizes = sorted((rng.randint(1, 1000) for _ in range(n)), reverse=True)
        place = least_capacity(sizes, 4)
        load = [sum(s for s, p in zip(sizes, place) if p == k) for k in range(4)]
        assert set(place) <= set(range(4))
        if n >= 50:
            assert max(load) - min(load) <= max(sizes)


@pytest.mark.parametrize("heavy", [[0.07], [0.1], [0.2], [0.33], [0.33, 0.2, 0.1], [0.9]])
def test_heavy_groups_leave_the_other_shards_equal(heavy):
    rng = random.Random(3)
    light = [rng.randint(50, 150) for _ in range(4000)]
    rest = sum(light) / (1 - sum(heavy))
    sizes = sorted([int(h * rest) for h in heavy] + light, reverse=True)
    load = [0] * 16
    for size, box in zip(sizes, least_capacity(sizes, 16)):
        load[box] += size
    assert sorted(load)[-len(heavy) :] == sorted(sizes[: len(heavy)])
    others = sorted(load)[: -len(heavy)]
    assert others[0] > 0 and others[-1] <= 1.02 * others[0]


def test_a_third_of_all_rows_alike(awkward):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(20)) for _ in range(400)]
    rows = list(enumerate(texts + ["copy " * 16] * 200))
    got = shard(awkward(rows)).groupBy("shard").sum("size").collect()
    load = sorted(r["sum(size)"] for r in got)
    assert len(load) == 16 and load[-1] == 200 * 81 and load[-2] <= 1.15 * load[0]


@pytest.mark.parametrize("fine", [2048, 2])
def test_odd_documents(awkward, odd_rows, no_docs, fine):
    got = shard(awkward(odd_rows), shards=4, fine=fine).collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    slots, place = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        place[(r.size, r.text_crc32)].add(r.shard)
    assert set(slots) <= set(range(4))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(p) == 1 for p in place.values())
    assert shard(no_docs).count() == 0


def test_bytes_are_near_equal(spark, sf_dir):
    rows = shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).groupBy("shard").sum("size").collect()
    load = [r["sum(size)"] for r in rows]
    assert len(load) == 16 and max(load) <= 1.15 * sum(load) / 16

"""Conversation repair against a row-by-row search over all sequences of edits."""

import hashlib
import random
import zlib

import pytest

from shelfwatch.llm import repair

KEPT = {"": "su", "s": "u", "u": "a", "a": "u"}  # what may follow


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))


def brute(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and hash of one conversation."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(repair.SPACES)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    # best (cost, audit, lines) for each last initial, row by row
    best = {"": (0, "", ())}

    def put(into, key, value):
        if key not in into or value[:2] < into[key][:2]:
            into[key] = value

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for last, (cost, audit, lines) in list(out.items()):
                for c in KEPT[last]:
                    if c in "ua":
                        put(out, c, (cost + 2, audit + "I", (*lines, f"{repair.NAMES[c]}:")))
        return out

    best = inserted(best)
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for last, (cost, audit, lines) in best.items():
            put(after, last, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = cost + (fault == "truncated")
                if role[:1] and role[:1] in KEPT[last]:
                    put(after, role[:1], (more, audit + "K", (*lines, f"{role}:{text}")))
                for c in KEPT[last]:
                    if c in "ua":
                        put(after, c, (more + 2, audit + "R", (*lines, f"{repair.NAMES[c]}:{text}")))
        best = inserted(after)
    cost, audit, lines = min(best[k] for k in ("", "a") if k in best)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha


def check(spark, rows, extra=""):
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, conv string, digest int, no int")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(table.repartition(3)).collect()}
    ids = {r[0] for r in rows}
    assert set(got) == ids
    for i in ids:
        assert got[i] == brute(damage([r for r in rows if r[0] == i])), i


def random_rows(rng, conv, n):
    texts = ["Yes.", "no", "Why?", "", "  \n", "Go on!", "a.b", "x" * 30 + ".", None]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    weights = [8, 8, 2, 1, 1, 1, 1]
    return [
        (conv, rng.choice([None, k, k, k, k // 2]), rng.choices(roles, weights)[0], rng.choice(texts[:-1] + [f"t{rng.random()}.", None]))
        for k in range(n)
    ]


def test_small_and_odd_conversations(spark):
    rng = random.Random(3)
    rows = [r for c in range(250) for r in random_rows(rng, c, rng.randrange(1, 9))]
    rows += random_rows(rng, None, 6) + [(900, None, None, None)] * 4 + [(901, 5, "user", "z" * 200_000)]
    rows += [(902, 1, "assistant", "Same.")] * 300  # one row many times
    check(spark, rows)


def test_conversations_of_many_spans(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(repair, "FAN", 3)  # several rounds
    rows = random_rows(rng, 1, 5000) + random_rows(rng, 2, 700) + random_rows(rng, 3, 40) + random_rows(rng, None, 600)
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_every_short_sequence_of_roles(n):
    rng = random.Random(n)
    for _ in range(300):
        rows = [(k, rng.choice(["user", "assistant", "system", "x"]), f"{k}{rng.choice(['.', ''])}") for k in range(n)]
        span = repair.bottom_up([repair.row_span(*r, False) for r in rows])
        assert repair.best_of(span) == brute(rows)[5:7]


def test_slices_follow_the_rows():
    assert list(repair.slices("KIKDIK", [1, 2, 1])) == [("K", 0), ("IKD", 1), ("IK", 3)]  # a system turn, then pairs
    assert list(repair.slices("KIRDK", [1, 2, 1])) == [("K", 0), ("IRD", 2), ("K", 2)]


def test_empty_and_dropped(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert repair.repair_conversations(spark.createDataFrame([], schema)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    (row,) = repair.repair_conversations(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query_covers_every_conversation(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = {r.conv_id: tuple(r)[1:] for r in repair.op12_conversation_repair(spark, sf_dir).collect()}
    assert set(got) == {r.conv_id for r in rows}
    for i in got:
        assert got[i] == brute(damage([tuple(r) for r in rows if r.conv_id == i]))

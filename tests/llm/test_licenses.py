import math
import random
import re

from shelfwatch.llm.licenses import PHRASES, TEMPLATES, scan_licenses


def brute(text, width=64, threshold=0.8):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [
        (k, label) for phrase, label in PHRASES.items() for k in range(len(w))
        if w[k : k + len(phrase.split())] == phrase.split()
    ]
    base, more, share = {label for _, label in places}, set(), 0.0
    for s in range(0, len(w), width // 2):
        block = set(w[s : s + width])
        for label, template in TEMPLATES:
            t = set(template.split())
            if len(block & t) >= math.ceil(threshold * len(t) - 1e-9):
                more.add(label)
                share = max(share, len(block & t) / len(t))
    starts = [k for k, _ in places]
    return (
        len(w), len(places), min(starts, default=None), max(starts, default=None), sorted(base), sorted(base | more),
        1.0 if places else share,
    )


def compare(docs, rows):
    got = sorted(
        (str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, list(r.base_labels), list(r.labels), round(r.score, 9))
        for r in scan_licenses(docs).collect()
    )
    want = sorted((str(i), *b[:-1], round(b[-1], 9)) for i, t in rows for b in [brute(t)])
    assert got == want


def test_odd_documents(awkward, odd_rows, no_docs):
    compare(awkward(odd_rows), odd_rows)
    assert scan_licenses(no_docs).count() == 0


def test_notices_whole_partial_and_shuffled(awkward):
    rng, rows = random.Random(4), []
    for i in range(120):
        words = [f"t{rng.randrange(50)}" for _ in range(rng.randrange(150))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(TEMPLATES)[1].split()
            notice = [x for x in notice if rng.random() < rng.choice([1, 0.85, 0.6])]
            if rng.random() < 0.3:
                rng.shuffle(notice)
            k = rng.randrange(len(words) + 1)
            words[k:k] = notice
        for _ in range(rng.randrange(3)):
            words[:0] = rng.choice(list(PHRASES)).split()
        rows.append((i, rng.choice([" ", "\n", ", "]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    rows.append((900, "mit license mit license, MIT  License gnu general public\nlicense xmit license mit licenses"))
    compare(awkward(rows), rows)

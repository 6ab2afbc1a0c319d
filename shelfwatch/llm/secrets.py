"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns near hits, checksums.

One automaton finds the keywords of all kinds in one pass over the lower-cased
bytes of a text; a kind's pattern is only tried where a keyword of it begins.
Runs of hex digits have no keyword: they are cut out by a class run of the
regular expression engine. Kinds that carry a checksum count only if it holds.

Base kinds, leftmost and non-overlapping within a kind; a match that is too
short is dropped, but has still used up its characters:

- ``assign``  a password-like name, ``:`` or ``=``, and a value of 12 or more characters
- ``access``  ``AKIA`` and more, 18 or more characters
- ``hex``     16 or more hex digits

Further kinds, validated by the checksum they embed:

- ``github``  ``ghp_`` and its kin, npm tokens: last six of 36 characters are a base-62 CRC-32
- ``jwt``     three base64url parts whose first two are JSON objects
- ``iban``    after the word ``iban``: ISO 13616 number, remainder 1 modulo 97
- ``card``    after ``card``, ``visa`` or the like: 13 to 19 digits that pass the Luhn sum

Spans are code points, end exclusive. Null and empty texts have none; repeated
rows are judged alike; other columns are not looked at. A text is scanned whole,
in memory that follows its own length. The documents are only mapped.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfwatch.llm import words as W

KINDS = ["assign", "access", "hex", "github", "jwt", "iban", "card"]
BASE = 3  # the first three kinds

# Fixed values.
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
GITHUB = re.compile(rb"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
JWT_PART = re.compile(rb"[A-Za-z0-9_-]+")
IBAN = re.compile(rb"iban[\x20:=#]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})", re.I)
CARD = re.compile(rb"(?:card|visa|mastercard|amex)[a-z\x20:=#.]{0,12}([0-9](?:[\x20-]?[0-9]){12,18})(?![0-9])", re.I)
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"],
    "jwt": ["eyj"],
    "iban": ["iban"],
    "card": ["card", "visa", "amex"],
}


def crc_holds(body: bytes, check: bytes) -> bool:
    """Whether ``check`` is the base-62 CRC-32 of ``body``."""
    digits = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    value, out = zlib.crc32(body), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = digits[digit : digit + 1] + out
    return out == check


def luhn_holds(digits: list[int]) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return 13 <= len(digits) <= 19 and (sum(odd) + sum(sum(divmod(2 * d, 10)) for d in even)) % 10 == 0


def json_holds(part: bytes) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


def iban_length(value: bytes) -> int:
    """Characters of ``value`` that are an account number with remainder 1; 0 if none are.

    Words may follow the number, so the longest prefix that holds counts.
    """
    for n in range(len(value), 14, -1):
        plain = value[:n].replace(b" ", b"").upper()
        if value[n - 1 : n] != b" " and 15 <= len(plain) <= 34:
            if int("".join(str(int(chr(c), 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                return n
    return 0


def find(kind: str, data: bytes, at: int) -> tuple[int, int, int, bool]:
    """(from, to, characters used up to, valid) of the match at a keyword; to == -1 if none."""
    if kind == "assign":
        m = ASSIGN.match(data, at)
        return (at, m.end(), m.end(), len(m[2]) >= 12) if m else (at, -1, at, False)
    if kind == "access":
        m = ACCESS.match(data, at)
        return (at, m.end(), m.end(), m.end() - at >= 18) if m else (at, -1, at, False)
    if kind == "github":
        m = GITHUB.match(data, at)
        return (at, m.end(), m.end(), crc_holds(m[1], m[2])) if m else (at, -1, at, False)
    if kind == "jwt":
        m = JWT.match(data, at)
        if not m:  # nor does one begin at a later keyword of this run, which ends at the same place
            begun = data.startswith(b"eyJ", at)
            return at, -1, JWT_PART.match(data, at).end() if begun else at, False
        return at, m.end(), m.end(), json_holds(m[1]) and json_holds(m[2])
    m = (IBAN if kind == "iban" else CARD).match(data, at)
    if not m:
        return at, -1, at, False
    if kind == "iban":
        n = iban_length(m[1])
        return m.start(1), m.start(1) + n, m.start(1) + n if n else at, n > 0
    return m.start(1), m.end(1), m.end(), luhn_holds([c - 48 for c in m[1] if 48 <= c <= 57])


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, keywords in KEYWORDS.items():
        for word in keywords:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all secrets, in that order, in code points."""
    data = text.encode()
    hits = [
        (end - size + 1, kind) for end, (kind, size) in automaton().iter(data.lower().decode("latin-1"))
    ]
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    used = dict.fromkeys(KEYWORDS, 0)
    for at, kind in sorted(hits):
        if at < used[kind]:
            continue
        start, end, past, valid = find(kind, data, at)
        used[kind] = max(used[kind], past)
        if valid and end > 0:
            out.append((start, KINDS.index(kind), end))
    out.sort()
    if out and not text.isascii():
        points, done, seen = {}, 0, 0
        for place in sorted({p for s, _, e in out for p in (s, e)}):
            seen += len(data[done:place].decode())
            points[place], done = seen, place
        out = [(points[s], k, points[e]) for s, k, e in out]
    return out


def _scan(batches):
    W.tidy()
    for batch in batches:
        found = [spans(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([[KINDS[k] for _, k, _ in x] for x in found], pa.list_(pa.string())),
                pa.array([[s for s, _, _ in x] for x in found], pa.list_(pa.int64())),
                pa.array([[e for _, _, e in x] for x in found], pa.list_(pa.int64())),
            ],
            names=["id", "kinds", "starts", "ends"],
        )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and secrets, an array of (kind, start, end) by start, then kind."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(
        _scan, f"id {kind}, kinds array<string>, starts array<bigint>, ends array<bigint>"
    )
    return found.select(
        F.col("id").alias(id_col),
        F.arrays_zip(F.col("kinds").alias("kind"), F.col("starts").alias("start"), F.col("ends").alias("end")).alias("secrets"),
    )


def joined(secrets):
    return F.array_join(
        F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All documents, whole texts."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("secrets", lambda s: s["kind"].isin(KINDS[:BASE]))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLES: dict[str, str] = {}

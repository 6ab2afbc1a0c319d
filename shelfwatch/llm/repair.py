"""Conversation structure repair by weighted interval parsing of a grammar in Chomsky normal form.

A sound conversation is empty, or turns of user and assistant in pairs that may
follow one of the system: ``(s?(ua)+)?`` over the initials of the roles. Rows may
be kept, given another role, deleted, or turns without text inserted, at a cost.

The grammar has one symbol for each pair of parser states: X[p,q] derives the
edits that lead from p to q. Its rules are X[p,q] -> X[p,r] X[r,q] and, for a
single row, the edits of that row; a closure adds any insertions before and
after. A cell of the table holds, for one span of rows and each symbol, the
minimum (cost, audit). As any two halves of a span have the same symbols, one way
of cutting it suffices: cells of spans of 1, 2, 4, ... rows are combined bottom
up. Minimum cells may be combined because of two audits of a span with equal cost
neither begins the other: it would have only insertions left, which cost.

Rows are sorted in ranges of (conversation, turn), which cut conversations of any
length in spans of at most ``SPAN`` rows. A conversation that lies in one span is
finished there. The others, two a partition and the long ones, are combined from
their spans in rounds of ``FAN`` neighbours; then every span replays its part of
the audit, and the hash runs over the pieces in order without holding them. One
task must read all of a conversation for that, as SHA-256 has no other way, but
only the text that is left, a span a row. Equal rows of a turn are counted before
the sort, so they are one row.

Defined cases: a null role or text is one space, a null id or turn is one space in
the damage key, null ids are one conversation; rows of a turn go by role, then
the digest of the text; a conversation without rows after the damage has zeros, an
empty audit and the hash of an empty string; roles count by their first character
as it stands; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfwatch.session import materialise

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
SPAN, SPAN_CHARS, FAN = 256, 1 << 20, 64
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1  # costs; CUT is that of a truncated row that stays
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}

# Parser states: 0 nothing yet, 1 after the system turn, 2 after a user, 3 after an assistant.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = 4, (0, 3)
Cell = tuple  # by symbol 4 * p + q: (cost, audit), or None where nothing leads from p to q


def _cell(ways: dict[tuple[int, int], tuple[int, str]]) -> Cell:
    return tuple(ways.get((p, q)) for p in range(STATES) for q in range(STATES))


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out = []
    for p in range(STATES):
        first = [(r, left[STATES * p + r]) for r in range(STATES) if left[STATES * p + r]]
        for q in range(STATES):
            best = None
            for r, a in first:
                b = right[STATES * r + q]
                if b and (best is None or a[0] + b[0] <= best[0]):
                    way = (a[0] + b[0], a[1] + b[1])
                    best = way if best is None else min(best, way)
            out.append(best)
    return tuple(out)


def _closure() -> Cell:
    """Any insertions: at most two, as two more lead back to the same state."""
    once = {(p, q): (INSERT, "I") for (p, c), q in NEXT.items() if c in NAMES}
    step = _cell(once | {(p, p): (0, "") for p in range(STATES)})
    return combined(step, step)


INSERTIONS = _closure()


@lru_cache(maxsize=None)
def leaf(initial: str, must_go: bool, truncated: bool) -> Cell:
    """The cell of one row, with insertions on both sides; ``initial`` is s, u, a or empty."""
    ways = {(p, p): (DELETE, "D") for p in range(STATES)}
    if not must_go:
        for p in range(STATES):
            edits = [(initial, truncated * CUT, "K")] + [(c, REROLE + truncated * CUT, "R") for c in NAMES]
            for c, cost, edit in edits:
                q = NEXT.get((p, c))
                if q is not None:
                    ways[p, q] = min(ways.get((p, q), (cost, edit)), (cost, edit))
    return combined(combined(INSERTIONS, _cell(ways)), INSERTIONS)


class Span(NamedTuple):
    """What is known of neighbouring rows, together with their cell."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None  # initials of the first and last row
    last: str | None = None
    low: int | None = None  # first and last turn
    high: int | None = None
    turns: int = 0
    cell: Cell = INSERTIONS


def merged(a: Span, b: Span) -> Span:
    if not a.rows or not b.rows:
        return a if a.rows else b
    same = a.high is not None and a.high == b.low
    return Span(
        a.rows + b.rows, a.blank + b.blank, a.duplicate + b.duplicate, a.truncated + b.truncated,
        a.illegal + b.illegal + (a.last + b.first not in LEGAL), a.first, b.last,
        b.low if a.low is None else a.low, a.high if b.high is None else b.high, a.turns + b.turns - same,
        combined(a.cell, b.cell),
    )


def bottom_up(spans: list[Span]) -> Span:
    """Neighbours combined again and again, so the length of the spans doubles."""
    while len(spans) > 1:
        spans = [reduce(merged, spans[k : k + 2]) for k in range(0, len(spans), 2)]
    return spans[0] if spans else Span()


def row_span(turn: int | None, role: str, text: str, again: bool) -> Span:
    """One row; ``again`` if its role and text were there before."""
    body, initial = text.rstrip(SPACES), role[:1]
    blank = not body
    again = again and not blank
    cut = not blank and not again and body[-1] not in ENDS
    cell = leaf(initial if initial in ("s", "u", "a") else "", blank or again, cut)
    return Span(1, int(blank), int(again), int(cut), 0, initial, initial, turn, turn, int(turn is not None), cell)


def best_of(span: Span) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a whole conversation."""
    return min(span.cell[q] for q in FINAL if span.cell[q])


def replay(said: Iterator[tuple[str, str]], audit: str, state: int) -> tuple[list[str], int]:
    """The lines that the edits leave of some rows, and the state after them."""
    lines = []
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(said)
        if edit != "D":
            initial = role[:1] if edit == "K" else "a" if state == 2 else "u"
            lines.append(f"{role if edit == 'K' else NAMES[initial]}:{text}")
            state = NEXT[state, initial]
    return lines, state


def slices(audit: str, rows: list[int]) -> Iterator[tuple[str, int]]:
    """For spans of so many rows: their part of the audit and the state before it."""
    lines = len(audit) - audit.count("D")
    system, at, before = lines % 2, 0, 0  # only with a system turn the number is odd
    for k, n in enumerate(rows):
        end = at
        while n and end < len(audit):
            n -= audit[end] != "I"
            end += 1
        part = audit[at:] if k == len(rows) - 1 else audit[at:end]
        yield part, 0 if not before else 1 if system and before == 1 else 3 - (before + system) % 2
        at, before = end, before + len(part) - part.count("D")


def damaged(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, weight (0: the row is dropped, 2: it is repeated) after the prescribed damage."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(words(conv_id), F.lit(":"), words(turn)).cast("binary")) % 20

    def change(case: Column) -> Column:
        body = F.when(case <= 1, "").when(case == 2, F.translate(words(text), ENDS, "")).otherwise(words(text))
        return F.struct(
            F.when(case == 4, "user").otherwise(words(role)).alias("role"), body.alias("text"),
            F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("weight"),
        )

    kept = rows.select(F.col(conv_id).alias("conv"), F.col(turn).cast("bigint").alias("turn"), change(kind).alias("row"))
    return kept.select("conv", "turn", "row.*")


def _said_again(rows: DataFrame) -> DataFrame:
    """Rows with ``digest`` and ``again``: whether role and text stand at an earlier turn; equal rows with their number."""
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("gone", F.col("weight") == 0)
    once = rows.groupBy("conv", "turn", "role", "text", "digest", "gone").agg(F.sum("weight").alias("copies"))
    first = (
        rows.where("NOT gone").groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
        .agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last"))
        .where("NOT (first <=> last)")
    )
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.struct("turn"))
    return once.join(first, same, "left").select(
        "conv", "turn", "role", "text", "digest", "gone", "copies", again.alias("again")
    )


FIGURES = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
SPANS = (
    "rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
    "low bigint, high bigint, turns bigint, cell array<struct<cost:bigint,audit:string>>"
)
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _figures(span: Span) -> dict:
    cost, audit = best_of(span)
    gaps = 0 if span.low is None else span.high - span.low + 1 - span.turns
    return dict(zip(COLUMNS, (gaps, span.blank, span.duplicate, span.truncated, span.illegal, cost, audit)))


def _out(span: Span) -> dict:
    return span._asdict() | {"cell": [way and {"cost": way[0], "audit": way[1]} for way in span.cell]}


def _in(row: dict) -> Span:
    cell = tuple(way and (way["cost"], way["audit"]) for way in row["cell"])
    return Span(**{name: row[name] for name in Span._fields[:-1]}, cell=cell)


def _hash(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _rows(batches, columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in columns))


class _Run:
    """The rows of one conversation in one partition, cut in spans."""

    def __init__(self, conv, whole: bool):
        self.conv, self.whole, self.done = conv, whole, []
        self._open()

    def _open(self) -> None:
        self.spans, self.said, self.chars = [], [], 0

    def add(self, span: Span, role: str, text: str) -> Iterator[dict]:
        self.spans.append(span)
        self.said.append((role, "" if span.blank or span.duplicate else text))  # such a row never stays
        self.chars += len(self.said[-1][1])
        if len(self.spans) >= SPAN or self.chars >= SPAN_CHARS:
            yield from self.close()

    def close(self) -> Iterator[dict]:
        """A span that is full: the conversation is not finished here."""
        self.whole = False
        yield self._part()
        self._open()

    def _part(self) -> dict:
        roles, texts = zip(*self.said) if self.said else ((), ())
        return {"conv": self.conv, "roles": list(roles), "texts": list(texts)} | _out(bottom_up(self.spans))

    def end(self, last: bool) -> Iterator[dict]:
        if self.whole and not last:
            figures = _figures(bottom_up(self.spans))
            lines, _ = replay(iter(self.said), figures["audit"], 0)
            yield {"conv": self.conv, "result": figures | {"repaired_sha256": _hash(lines)}}
        else:
            yield self._part()


def _parse(schema: pa.Schema):
    """Sorted rows -> the results of conversations that lie inside the partition, the spans of all others."""

    def found(batches):
        run, start = None, True
        for conv, turn, role, text, gone, copies, again in _rows(
            batches, ["conv", "turn", "role", "text", "gone", "copies", "again"]
        ):
            if run is None or conv != run.conv:
                if run is not None:
                    yield from run.end(last=False)
                run, start = _Run(conv, whole=not start), False
            for k in range(0 if gone else copies):
                yield from run.add(row_span(turn, role, text, again or k > 0), role, text)
        if run is not None:
            yield from run.end(last=True)

    def parse(batches):
        rows = []
        for number, row in enumerate(found(batches)):
            rows.append(row | {"number": number})
            if len(rows) >= 512:
                yield from pa.Table.from_pylist(rows, schema).to_batches()
                rows = []
        yield from pa.Table.from_pylist(rows, schema).to_batches()

    return parse


def _arrow(spark: SparkSession, ddl: str, **other) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_schema(spark, ddl, **other), prefers_large_types=False)


def _schema(spark: SparkSession, ddl: str, **other):
    return spark.createDataFrame([], f"conv {other['conv']}, {ddl}").schema


def _combine(schema: pa.Schema):
    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["no"])
        span = bottom_up([_in(r) for r in rows])
        return pa.Table.from_pylist([{"conv": rows[0]["conv"], "no": rows[0]["no"] // FAN} | _out(span)], schema)

    return combine


def _long(spark: SparkSession, parts: DataFrame, conv: str) -> DataFrame:
    """The results of conversations that are cut in several spans."""
    order = Window.partitionBy("conv").orderBy("part", "number")
    # at most one span for each SPAN rows or SPAN_CHARS characters of a conversation, whose audit is one string
    parts = materialise(parts.withColumn("no", F.row_number().over(order).cast("bigint") - 1), "repair-parts")
    kind = f"no bigint, {SPANS}"
    schema = _arrow(spark, kind, conv=conv)
    spans = parts.select("conv", "no", *Span._fields)
    while True:  # each round is a factor of FAN
        grouped = spans.groupBy("conv", F.expr(f"no div {FAN}").alias("group"))
        spans = materialise(grouped.applyInArrow(_combine(schema), _schema(spark, kind, conv=conv)), "repair-spans")
        if spans.where("no > 0").isEmpty():
            break

    figures = _arrow(spark, FIGURES, conv=conv)

    def finish(batches):
        for batch in batches:
            rows = [{"conv": r["conv"]} | _figures(_in(r)) for r in batch.to_pylist()]
            yield from pa.Table.from_pylist(rows, figures).to_batches()

    roots = materialise(spans.mapInArrow(finish, _schema(spark, FIGURES, conv=conv)), "repair-roots")
    sizes = parts.groupBy(F.col("conv").alias("c")).agg(F.array_sort(F.collect_list(F.struct("no", "rows"))).alias("sizes"))
    cut = "no bigint, slice string, state int"
    cut_schema = _arrow(spark, cut, conv=conv)

    def share(batches):
        for conv, audit, sizes in _rows(batches, ["conv", "audit", "sizes"]):
            found = slices(audit, [s["rows"] for s in sizes])
            rows = [{"conv": conv, "no": s["no"], "slice": p, "state": q} for s, (p, q) in zip(sizes, found)]
            yield from pa.Table.from_pylist(rows, cut_schema).to_batches(max_chunksize=4096)

    shares = roots.join(sizes, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "audit", "sizes")
    shares = shares.mapInArrow(share, _schema(spark, cut, conv=conv)).withColumnsRenamed({"conv": "c", "no": "n"})
    here = F.col("conv").eqNullSafe(F.col("c")) & (F.col("no") == F.col("n"))
    text_schema = _arrow(spark, "no bigint, text string", conv=conv)

    def texts(batches):
        for conv, no, roles, said, part, state in _rows(batches, ["conv", "no", "roles", "texts", "slice", "state"]):
            lines, _ = replay(iter(zip(roles, said)), part, state)
            text = "\n".join(lines) if lines else None
            yield from pa.Table.from_pylist([{"conv": conv, "no": no, "text": text}], text_schema).to_batches()

    pieces = parts.join(shares, here).select("conv", "no", "roles", "texts", "slice", "state")
    pieces = pieces.mapInArrow(texts, _schema(spark, "no bigint, text string", conv=conv))
    hash_schema = _arrow(spark, "repaired_sha256 string", conv=conv)

    def hashes(batches):
        open_, running, lines = False, hashlib.sha256(), False
        last = None
        for conv, text in _rows(batches, ["conv", "text"]):
            if open_ and conv != last:
                yield from pa.Table.from_pylist([{"conv": last, "repaired_sha256": running.hexdigest()}], hash_schema).to_batches()
                running, lines = hashlib.sha256(), False
            open_, last = True, conv
            if text is not None:
                running.update((("\n" if lines else "") + text).encode())
                lines = True
        if open_:
            yield from pa.Table.from_pylist([{"conv": last, "repaired_sha256": running.hexdigest()}], hash_schema).to_batches()

    in_order = pieces.repartition("conv").sortWithinPartitions("conv", "no")
    hashed = in_order.mapInArrow(hashes, _schema(spark, "repaired_sha256 string", conv=conv)).withColumnRenamed("conv", "c")
    return roots.join(hashed, F.col("conv").eqNullSafe(F.col("c"))).drop("c")


def repair(rows: DataFrame) -> DataFrame:
    """One result a conversation of rows (conv, turn, role, text, weight), rows of weight 0 being dropped ones.

    Columns: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    spark, conv = rows.sparkSession, rows.schema["conv"].dataType.simpleString()
    kind = f"number bigint, result struct<{FIGURES}, repaired_sha256 string>, roles array<string>, texts array<string>, {SPANS}"
    order = ["conv", "turn", "role", "digest", "gone"]
    in_order = _said_again(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    parsed = in_order.mapInArrow(_parse(_arrow(spark, kind, conv=conv)), _schema(spark, kind, conv=conv))
    parsed = materialise(parsed.withColumn("part", F.spark_partition_id()), "repair")
    short = parsed.where("result IS NOT NULL").select("conv", "result.*")
    return short.unionByName(_long(spark, parsed.where("result IS NULL"), conv))


def repair_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Conversations after the prescribed damage, repaired; one row for every id of ``rows``."""
    return repair(damaged(rows, conv_id, turn, role, text)).withColumnRenamed("conv", conv_id)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations."""
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLES: dict[str, str] = {}

"""License scan: an exact set-similarity join of text blocks with notice templates.

Only DataFrame functions. A block is ``WIDTH`` consecutive words, one beginning
every half block, over the whole text; every passage of up to half a block lies
in one of them. A block matches a template if it holds at least ``threshold`` of
the template's distinct words. All such pairs are found:

1. The words of all templates are counted over the whole corpus and ordered by
   frequency, rarest first.
2. Prefix filter: a match must hold one of the template's ``size - need + 1``
   rarest words, so texts with none of any template's prefix words are done.
3. Length filter: a block needs ``need`` template words at all.
4. Positional filter: from the first shared prefix word on, both sides must have
   ``need`` words left.
5. Pairs that are left are counted exactly.

Nothing but the (bounded) template words is collected, and what moves are the
template words of texts that hold a rare one, by (row, block).

Besides, the places of the base phrases are found: their words, consecutively.

Defined cases: a null text counts as empty and has no words; repeated rows are
judged one by one; an empty table gives an empty result. Other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from shelfwatch.llm.exact import UPPER
from shelfwatch.session import materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
WIDTH = 64
THRESHOLD = 0.8

# Phrases that count as they stand, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Common notices of public licenses, lower-cased, and their labels.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "dedicated to the public domain under the creative commons cc0 1 0 universal dedication"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
]


def spaced(text: Column) -> Column:
    """The lower-cased text with every character between words a space, in one pass."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER + GAPS, UPPER.lower() + " " * len(GAPS))


def words_of(body: Column) -> Column:
    """The words of a spaced text."""
    return F.array_remove(F.split(body, " ", -1), "")


def base_places(words: Column, body: Column, phrase: str) -> Column:
    """(number, first start, last start) of the places of ``phrase``; null if a word of it is missing."""
    parts = phrase.split()
    # Every word is wrapped in spaces of its own, so neighbouring places do not share any.
    wrapped = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    pieces = F.split(wrapped, " " + "  ".join(parts) + " ", -1)
    count = lambda piece: F.size(F.filter(F.split(piece, " "), lambda x: x != ""))
    number = (F.size(pieces) - 1).cast("bigint")
    first = count(F.element_at(pieces, 1)).cast("bigint")
    last = (F.size(words) - count(F.element_at(pieces, -1)) - len(parts)).cast("bigint")
    found = F.struct(number.alias("n"), F.when(number > 0, first).alias("first"), F.when(number > 0, last).alias("last"))
    held = F.lit(True)
    for word in sorted(parts, key=len, reverse=True):
        held = held & F.contains(body, F.lit(word))
    return F.when(held, found)


def token_order(texts: DataFrame, tokens: list[str]) -> dict[str, int]:
    """Rank of each token, rarest in the corpus first; equal counts in the order of the alphabet."""
    counts = {
        r["word"]: r["n"]
        for r in texts.select(F.explode(F.split("body", " ", -1)).alias("word"))
        .where(F.col("word").isin(tokens)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    return {t: k for k, t in enumerate(sorted(tokens, key=lambda t: (counts.get(t, 0), t)))}


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None,
    threshold: float = THRESHOLD, width: int = WIDTH,
) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels
    and labels (arrays, sorted), and score, the greatest share of a template that a
    block holds (1 where a base phrase stands, 0 where nothing matches)."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    if any(len(text.split()) > width // 2 for _, text in templates):
        raise ValueError("a template is longer than half a block")
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), spaced(F.col(text_col)).alias("body")
    )
    tokens = sorted({w for _, text in templates for w in text.split()})
    rank = token_order(texts, tokens)
    sets = []  # (label, ranks of the words in order, words needed)
    for label, text in templates:
        ranks = sorted({rank[w] for w in text.split()})
        sets.append((label, ranks, math.ceil(threshold * len(ranks) - 1e-9)))
    prefix_ranks = {r for _, ranks, need in sets for r in ranks[: len(ranks) - need + 1]}
    by_rank = sorted(rank, key=rank.get)

    read = texts.withColumn("words", words_of(F.col("body")))
    for k, phrase in enumerate(phrases):
        read = read.withColumn(f"base{k}", base_places(F.col("words"), F.col("body"), phrase))
    base = [F.col(f"base{k}") for k in range(len(phrases))]
    order = F.array(*[F.lit(t) for t in by_rank])
    spots = F.filter(
        F.transform(
            "words", lambda w, i: F.struct(i.alias("at"), (F.array_position(order, w) - 1).cast("int").alias("rank"))
        ),
        lambda s: s["rank"] >= 0,
    )
    rare = F.array(*[F.lit(by_rank[r]) for r in sorted(prefix_ranks)])
    none = F.lit(0).cast("bigint")
    rows = materialise(
        read.select(
            "row", "id", F.size("words").cast("bigint").alias("n_words"),
            sum((F.coalesce(b["n"], none) for b in base), none).alias("n_base"),
            F.array_min(F.array(*[b["first"] for b in base])).alias("first_word"),
            F.array_max(F.array(*[b["last"] for b in base])).alias("last_word"),
            F.array_sort(F.array_distinct(F.array_compact(F.array(
                *[F.when(b["n"] > 0, F.lit(label)) for b, label in zip(base, phrases.values())]
            )))).alias("base_labels"),
            F.when(F.arrays_overlap("words", rare), spots).alias("spots"),
        ),
        "licenses",
    )
    half = width // 2
    posted = rows.where(F.col("spots").isNotNull()).select("row", F.explode("spots").alias("s")).select(
        "row", F.col("s.rank").alias("rank"), F.floor(F.col("s.at") / half).cast("int").alias("half")
    )
    blocks = (
        posted.select("row", "rank", F.explode(F.array("half", F.col("half") - 1)).alias("block"))
        .where("block >= 0").groupBy("row", "block").agg(F.sort_array(F.collect_set("rank")).alias("ranks"))
    )
    matched = F.array_compact(F.array(*[_match(F.col("ranks"), *s) for s in sets]))
    labelled = (
        blocks.select("row", F.explode(matched).alias("m"))
        .groupBy("row").agg(F.collect_set("m.label").alias("more"), F.max("m.share").alias("share"))
    )
    found = rows.drop("spots").join(labelled, "row", "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels",
        every.alias("labels"), score.alias("score"),
    )


def _match(block: Column, label: str, ranks: list[int], need: int) -> Column:
    """(label, share) if the block holds ``need`` of the template's words, else null.

    ``block`` has the ranks of its template words in order, so places in both
    lists bound what can still be shared.
    """
    whole = F.array(*[F.lit(r) for r in ranks])
    prefix = F.array(*[F.lit(r) for r in ranks[: len(ranks) - need + 1]])
    first = F.element_at(F.array_intersect(block, prefix), 1)  # in the block's order: the rarest
    left = F.least(F.size(block) - F.array_position(block, first), F.lit(len(ranks)) - F.array_position(whole, first)) + 1
    shared = F.size(F.array_intersect(block, whole))
    hit = F.when(
        (F.size(block) >= need) & F.arrays_overlap(block, prefix),
        F.when(left >= need, F.when(shared >= need, F.struct(F.lit(label).alias("label"), (shared / len(ranks)).alias("share")))),
    )
    return hit


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents, whole texts."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn(
        "labels", F.array_join("labels", ",")
    )


def oracle() -> str:
    """Every block against every template, by list functions."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"('{label}', {quoted(sorted(set(text.split())))})" for label, text in TEMPLATES)
    phrases = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in PHRASES.items())
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({lower}, '{WORD}+') AS w FROM documents),
templates(label, t) AS (VALUES {templates}),
phrases(label, p) AS (VALUES {phrases}),
places AS (
    SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs), phrases
    WHERE w[i] = p[1] AND w[i : i + len(p) - 1] = p
), base AS (
    SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
        list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY doc_id
), blocks AS (
    SELECT doc_id, list_distinct(w[s + 1 : s + {WIDTH}]) AS b
    FROM (SELECT doc_id, w, unnest(range(0, len(w), {WIDTH // 2})) AS s FROM docs)
), hits AS (
    SELECT doc_id, label, len(list_intersect(b, t)) AS n, len(t) AS size FROM blocks, templates
), found AS (
    SELECT doc_id, list(DISTINCT label) AS labels, max(n / size) AS share FROM hits
    WHERE n >= ceil({THRESHOLD} * size - 1e-9) GROUP BY doc_id
)
SELECT docs.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(array_to_string(base.labels, ','), '') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLES = {"op5_license_scan": oracle()}

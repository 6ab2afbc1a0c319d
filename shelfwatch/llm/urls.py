"""URL filter: rules on host and path, and naive Bayes over segmented host words for all other URLs.

Names in hosts are often words run together. The runs of letters of all hosts are
split by a unigram model with Viterbi's algorithm. The model counts the words of
all pages' texts. Only the words that occur inside a run matter to it, so the
runs' substrings are joined with the counts and no dictionary is broadcast. Each
run is split once, however many URLs have it.

A multinomial naive Bayes model then scores host words and path tokens. It learns
from the URLs that a rule decides, all of them, and judges the others. Tokens are
counted in ``2**BITS`` buckets of a hash, so the model that goes to every task is
one megabyte at any size of the table; at that size few tokens share a bucket
with one of another leaning.

Defined cases: a null URL or one without ``://`` has an empty host and path and no
rule, its score is that of the classes alone; a host may have any characters, port
and user included; runs of over ``LABEL`` letters and hosts of over ``HOST``
characters are no names of the DNS and count as they stand; of equally probable
splits the one whose last words are longer counts; a score of 0 allows;
repeated rows are judged alike; a null page has no words; without labelled URLs
all others are allowed; an empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwatch.llm import words as W
from shelfwatch.session import materialise

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
LABEL, HOST = 63, 253  # letters of a name and characters of a host in the DNS
WORD = 24  # letters of the longest word that a run is split into
BITS = 18
MARKUP = "<[^<>]*>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, empty without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r)):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): lower-cased runs of letters of the column ``body``, markup left out."""
    plain = F.lower(F.regexp_replace("body", MARKUP, " "))
    found = texts.select(F.explode(F.split(plain, "[^\\p{L}]+")).alias("word"))
    return found.where(f"length(word) BETWEEN 1 AND {WORD}").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_split(run: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """Most probable words of ``run``; ``known`` has the count of the word at (start, end).

    An unknown word of k letters has the chance 10 ** (1 - k) / total.
    """
    best, cut = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
    scale = math.log(max(total, 1))
    for end in range(1, len(run) + 1):
        for start in range(max(0, end - WORD), end):
            n = known.get((start, end))
            chance = math.log(n) - scale if n else (1 - end + start) * math.log(10) - scale
            if best[start] + chance > best[end]:
                best[end], cut[end] = best[start] + chance, start
    words, end = [], len(run)
    while end:
        words.append(run[cut[end] : end])
        end = cut[end]
    return words[::-1]


def split_runs(runs: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(run, words): distinct runs of letters and their words, joined by spaces."""
    lengths = lambda start: F.sequence(F.lit(1), F.least(F.length("run") - start + 1, F.lit(WORD)))
    places = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length("run")),
            lambda start: F.transform(
                lengths(start),
                lambda n: F.struct((start - 1).alias("start"), F.substring("run", start, n).alias("word")),
            ),
        )
    )
    asked = runs.select("run", F.explode(places).alias("at")).select("run", "at.start", "at.word")
    known = asked.join(counts, "word").groupBy("run").agg(
        F.collect_list(F.struct("start", F.length("word").alias("length"), "n")).alias("known")
    )  # at most LABEL * WORD a run

    def split(batches):
        for batch in batches:
            found = []
            for run, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counted = {(p["start"], p["start"] + p["length"]): p["n"] for p in places or ()}
                found.append(" ".join(best_split(run, counted, total)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["run", "words"])

    return runs.join(known, "run", "left").select("run", "known").mapInArrow(split, "run string, words string")


def host_words(hosts: DataFrame, texts: DataFrame) -> DataFrame:
    """(host, words) for every host of ``hosts`` that is a name of the DNS by its length."""
    counts = materialise(count_words(texts), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hosts = materialise(hosts.select("host").where(f"length(host) <= {HOST}").distinct(), "hosts")
    pieces = hosts.select(
        "host", F.posexplode(F.regexp_extract_all("host", F.lit("\\p{L}+|\\p{N}+"), F.lit(0))).alias("place", "run")
    )
    runs = pieces.select("run").where(f"length(run) <= {LABEL} AND run RLIKE '^\\\\p{{L}}'").distinct()
    split = split_runs(materialise(runs, "runs"), counts, total)
    placed = pieces.join(split, "run", "left").groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("place", F.coalesce("words", "run").alias("words")))).alias("all")
    )
    return placed.select("host", F.array_join("all.words", " ").alias("words"))


class Bayes(NamedTuple):
    weight: np.ndarray  # log-likelihood of a bucket's tokens in blocked over allowed URLs
    prior: float


def _buckets(column: pa.Array) -> Iterable[tuple[np.ndarray, np.ndarray, int, int]]:
    """Bucket and row of every token, with the first and last row of a piece."""
    for row, stop, data, offsets in W.pieces(column):
        words = W.split(data, offsets, W.LETTERS)
        yield (words.hash & np.uint64((1 << BITS) - 1)).astype(np.int64), words.owner(), row, stop


def _count(batches):
    counts = np.zeros((2, 1 << BITS), np.int64)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        kind = np.array(batch.column(0).to_pylist(), np.int64)
        rows += np.bincount(kind, minlength=2)
        for bucket, owner, row, stop in _buckets(batch.column(1)):
            of_row = kind[row:stop][owner]
            for k in (0, 1):
                counts[k] += np.bincount(bucket[of_row == k], minlength=1 << BITS)
    for k in (0, 1):
        seen = np.flatnonzero(counts[k])
        values = [np.append(seen, -1), np.append(counts[k][seen], rows[k])]  # -1: the rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(values[0]), k)), *map(pa.array, values)], names=["kind", "bucket", "n"]
        )


def learn(labelled: DataFrame) -> Bayes:
    """Naive Bayes with add-one smoothing from rows (blocked 0/1, tokens); at most 2**(BITS+1) sums reach the driver."""
    found = labelled.mapInArrow(_count, "kind bigint, bucket bigint, n bigint")
    sums = found.groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    kind, bucket, n = (sums[c].to_numpy() for c in ("kind", "bucket", "n"))
    counts, rows = np.zeros((2, 1 << BITS)), np.zeros(2)
    inside = bucket >= 0
    counts[kind[inside], bucket[inside]] = n[inside]
    rows[kind[~inside]] = n[~inside]
    if not rows.all():  # one class or none: what the rules say of it says nothing of others
        return Bayes(np.zeros(1 << BITS, np.float32), float(np.sign(rows[1] - rows[0])))
    seen = (counts.sum(axis=0) > 0).sum()
    chance = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + seen + 1))
    return Bayes((chance[1] - chance[0]).astype(np.float32), float(np.log(rows[1] / rows[0])))


def _score(sent, tokens_at: int):
    def run(batches):
        model = sent.value
        for batch in batches:
            scores = [np.zeros(0)]
            for bucket, owner, row, stop in _buckets(batch.column(tokens_at)):
                scores.append(model.prior + np.bincount(owner, model.weight[bucket], stop - row))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(scores))], names=[*batch.schema.names, "score"]
            )

    return run


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
    text_col: str = "html",
) -> DataFrame:
    """One row a page: id, host, path, rule, verdict (allow or block), words of the host, score (over 0: block)."""
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("id"), *[c.alias(n) for n, c in zip(("host", "path"), host_and_path(F.col(url_col)))])
    split = host_words(urls, pages.select(F.col(text_col).alias("body")))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    tokens = F.concat_ws(" ", F.coalesce("words", "host"), "path")
    parsed = urls.join(split, "host", "left").withColumn("found", rule).select(
        "id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"),
        F.coalesce("words", "host").alias("words"), tokens.alias("tokens"),
    )
    parsed = materialise(parsed, "urls")
    labelled = parsed.where("ruled IS NOT NULL").select((F.col("ruled") == "block").cast("bigint").alias("blocked"), "tokens")
    sent = spark.sparkContext.broadcast(learn(labelled))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parsed.schema) + ", score double"
    scored = parsed.mapInArrow(_score(sent, parsed.columns.index("tokens")), schema)
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "words", "score")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URLs of all pages."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op11_url_filter": op11_url_filter}
ORACLES: dict[str, str] = {}

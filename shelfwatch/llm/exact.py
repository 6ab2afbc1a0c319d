"""Exact dedup by a tree merge of sorted digest runs, with DataFrame functions only.

Each partition of the scan is a run: its digests with one identifier each. In a
round, ``fan_in`` runs are merged into one: rows meet on (merged run, digest),
each task combines its own rows before they move, and the smallest (or largest)
identifier of equal digests is retained. The minimum of a struct makes Spark
merge sorted rows, so a round is a multiway merge of sorted runs. No round has
an unsplit hot group: a digest that a third of all rows share arrives with one
row for each run, then one for each merged run.

The rounds are binomial exchanges over digest ranges, not a merge into one
place: rows are dealt by (run, digest), so the last round's digests are spread
over all tasks.

An equal digest is verified by an equal byte length and a second, independent
hash, which are part of the key at every level.

Defined cases: a null text counts as empty; ids may be of any orderable type, a
null id is never kept if another row of the group has an id; of rows that repeat
the kept id as well, one is kept; an empty table gives an empty result. Other
columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfwatch.session import materialise

RUNS = 256
FAN_IN = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["digest", "length", "second"]


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else changed; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def digest_rows(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """One small row per document: its run, its place, its id and the three parts of the key."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    return rows.select(
        F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"),
        F.monotonically_increasing_id().alias("row"),
        "id",
        F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"),
        F.octet_length("body").alias("length"),
        F.xxhash64("body").alias("second"),
    )


def merge_runs(rows: DataFrame, keep: str, runs: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """(first round, last round): the kept identifier and the rows of each key."""
    pick = F.min if keep == "smallest" else F.max
    first_ids = F.col("id").isNull() if keep == "smallest" else F.col("id").isNotNull()
    level = rows.select(
        F.floor(F.col("run") / fan_in).cast("int").alias("run"), *KEY,
        F.struct(first_ids.alias("order"), "id", "row").alias("best"), F.lit(1).cast("bigint").alias("n"),
    )
    levels, left = [], -(-runs // fan_in)
    while True:
        level = level.groupBy("run", *KEY).agg(pick("best").alias("best"), F.sum("n").alias("n"))
        levels.append(level)
        if left == 1:
            return levels[0], levels[-1]
        left = -(-left // fan_in)
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    runs: int = RUNS, fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per document: its id, keep_id (id of the row that stays), group_size,
    kept, and text_sha256 of the lower-cased text."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"unknown order {keep!r}")
    rows = materialise(digest_rows(docs, id_col, text_col, runs), "digests")
    first, last = merge_runs(rows, keep, runs, fan_in)
    # Back down the tree: a hot digest's rows are spread over the merged runs of the first round.
    answers = first.select("run", *KEY).join(last.select(*KEY, "best", "n"), KEY)
    found = rows.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).join(answers, ["run", *KEY])
    return found.select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The documents that stay, with all their columns.

    Rows are found again by id and digest. Rows that repeat both are one
    document, of which one row stays.
    """
    names = docs.columns
    marks = ["shelfwatch_id", "shelfwatch_sha256"]
    stay = exact_dedup(docs, id_col, text_col, keep).where("kept").select(
        F.col(id_col).alias(marks[0]), F.col("text_sha256").alias(marks[1])
    )
    tagged = docs.withColumn("shelfwatch_mark", F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    same = tagged[id_col].eqNullSafe(stay[marks[0]]) & (tagged["shelfwatch_mark"] == stay[marks[1]])
    return tagged.join(stay, same, "left_semi").dropDuplicates([id_col, "shelfwatch_mark"]).select(*names)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents; of equal texts the row with the largest doc_id stays."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


SQL = """
WITH t AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
    doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLES = {"op1_exact_dedup": SQL}

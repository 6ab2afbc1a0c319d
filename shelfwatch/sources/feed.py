"""The positional CSV price feed: seven columns, no header, UTF-8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions import prices as P
from ..functions.text import strip

RAW_SCHEMA = ", ".join(f"{c} STRING" for c in K.FEED_COLUMNS)
_CORRUPT = "bad_record"


def read_feed(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Feed rows as strings plus ``row_order``, their position in the file(s).

    The order is (file, split offset, row inside the split), with the files in the order of their
    names, so it needs no single-task read. ``multi_line`` is only for feeds with line breaks inside
    quoted fields; such files cannot be split.
    """
    raw = (
        spark.read.schema(f"{RAW_SCHEMA}, {_CORRUPT} STRING")
        .option("header", False)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .csv(path)
    )
    placed = raw.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_offset"),
        F.monotonically_increasing_id().alias("_row"),
    ).join(F.broadcast(_file_places(spark, path)), "_path", "left")
    unlisted = F.raise_error(F.concat(F.lit("feed file not listed: "), "_path")).cast("int")
    file = F.coalesce("_file", unlisted).alias("file")
    position = F.struct(file, F.col("_offset").alias("offset"), F.col("_row").alias("row"))
    return placed.select(*raw.columns, position.alias("row_order")).fillna("", subset=K.FEED_COLUMNS)


def _file_places(spark: SparkSession, path: str) -> DataFrame:
    """Each file's place in the order of their names, so that rows carry a number and not a long name.

    The files are only listed, not read.
    """
    files = spark.read.format("binaryFile").load(path).select("_metadata.file_path").collect()
    places = [(name, n) for n, name in enumerate(sorted(f[0] for f in files))]
    return spark.createDataFrame(places, "_path STRING, _file INT")


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The same seven string columns from CSV text held in a column.

    A line with more or fewer fields is kept whole in ``bad_record``.
    """
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    fields = F.from_csv(F.col(line), f"{RAW_SCHEMA}, {_CORRUPT} STRING", options)
    kept = [c for c in lines.columns if c != line]
    # inline() parses each line once; plain field access would repeat the parse per field.
    return lines.select(*kept, F.inline(F.array(fields))).fillna("", subset=K.FEED_COLUMNS)


def _problem(columns: list[str]) -> Column:
    brand = strip(F.col("brand_num")).try_cast("int")
    broken = F.col(_CORRUPT).isNotNull() if _CORRUPT in columns else F.lit(False)
    return (
        F.when(broken, F.lit("wrong number of columns"))
        .when(brand.isNull(), F.concat(F.lit("bad brand number: "), "brand_num"))
        .when(
            P.parse_season(F.col("season")).isNull(),
            F.concat(F.lit("unrecognised season code: "), "season"),
        )
        .when(
            P.feed_price_is_bad(F.col("price")), F.concat(F.lit("unparseable price: "), "price")
        )
    )


def rejects(raw: DataFrame) -> DataFrame:
    """Rows that do not parse, with the reason."""
    # inline() makes each value once; else the filter repeats how a column is made for every time it is looked at.
    values = F.array(F.struct(*K.FEED_COLUMNS))
    order, kept = raw.columns, [c for c in raw.columns if c not in K.FEED_COLUMNS]
    raw = raw.select(*kept, F.inline(values)).select(*order)
    return raw.withColumn("reason", _problem(raw.columns)).where(F.col("reason").isNotNull())


def parse_feed(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Typed feed rows. Strict: any bad value fails the job. Lenient: see ``rejects``."""
    brand = strip(F.col("brand_num")).try_cast("int")
    season = P.parse_season(F.col("season"))
    price = P.parse_feed_price(F.col("price"))
    sku = strip(F.col("sku"))
    if strict:
        # Each failing column raises its own error, so nothing is evaluated twice.
        brand = _or_fail(brand, "brand_num", "bad brand number: ")
        season = _or_fail(season, "season", "unrecognised season code: ")
        given = ~P.is_null_marker(F.col("price"))
        price = F.when(given, _or_fail(price, "price", "unparseable price: "))
        if _CORRUPT in raw.columns:
            broken = F.raise_error(F.concat(F.lit("bad feed row: "), _CORRUPT)).cast("string")
            sku = F.when(F.col(_CORRUPT).isNotNull(), broken).otherwise(sku)
    else:
        raw = raw.where(_problem(raw.columns).isNull())
    kept = [c for c in raw.columns if c not in K.FEED_COLUMNS and c != _CORRUPT]
    return raw.select(
        sku.alias("sku"),
        brand.alias("brand_num"),
        strip(F.col("category")).alias("category"),
        strip(F.col("name")).alias("name"),
        strip(F.col("grade")).alias("grade"),
        season.alias("observed_at"),
        price.alias("price"),
        *kept,
    )


def _or_fail(parsed: Column, column: str, reason: str) -> Column:
    return F.coalesce(parsed, F.raise_error(F.concat(F.lit(reason), F.col(column))))

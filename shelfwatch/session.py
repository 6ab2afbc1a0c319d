"""Session settings, the shared scratch location and small size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Broadcasting is only ever asked for below this many rows (checked by count).
SMALL_TABLE_ROWS = 100_000
# Bytes of files whose rows ``spread`` gives to one task, some hundred thousand short rows.
SPREAD_BYTES = 4 << 20
# Bytes of files whose rows one task sorts.
SORTED_BYTES = 8 << 20
# Bytes of files whose rows are shuffled at a time by a step that works part by part, and the most
# parts: each reads the files once more, so a step reads them four times at most.
PART_BYTES = 8 << 20
MOST_PARTS = 4

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Whole HTML pages cross to Python, so batches are kept small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("shelfwatch")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SHELFWATCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting, as in tests, gets a temporary
    folder of its own, which goes when the process ends.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", ""
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    fallback = tempfile.mkdtemp(prefix="shelfwatch-")
    atexit.register(shutil.rmtree, fallback, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/shelfwatch/{label}-{uuid.uuid4().hex}"


_written: list[str] = []


@contextmanager
def cleared_scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``materialise`` writes inside, once their users are done.

    For jobs: everything that is read from them must have been written by then.
    """
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            delete_folder(spark, path)
        del _written[before:]


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back."""
    return materialise_parts([df], label)


def materialise_parts(parts: Sequence[DataFrame], label: str) -> DataFrame:
    """One table of all rows of ``parts``, written one after the other as ``materialise`` does.

    With ``lean_scratch`` the shuffle files of only one part are on disk at a time.
    """
    spark = parts[0].sparkSession
    path = scratch_path(spark, label)
    _written.append(path)
    for df in parts:
        df.write.mode("append").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more; other files stay."""
    read = {file.rsplit("/", 2)[-2] for file in table.inputFiles()}
    for path in _written:
        if path.rsplit("/", 1)[-1] in read:
            delete_folder(table.sparkSession, path)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def lean_scratch(spark: SparkSession) -> AbstractContextManager[None]:
    """What is written inside leaves no shuffle files behind, else they stay until the driver collects
    garbage, and tables are packed tighter."""
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    return _settings(spark, {cleanup: "true", "spark.sql.parquet.compression.codec": "zstd"})


def parts_of(*tables: DataFrame) -> int:
    """In how many parts to shuffle rows of ``tables``. Only the lists of files are looked at."""
    size = sum(_file_bytes(t.sparkSession, t.inputFiles()) for t in tables)
    return max(1, min(MOST_PARTS, size // PART_BYTES))


def part(df: DataFrame, key: Sequence[Column], no: int, parts: int) -> DataFrame:
    """Rows of ``df`` whose ``key`` falls in part ``no``; every row is in one part, nulls too."""
    return df if parts == 1 else df.where(F.pmod(F.xxhash64(*key), F.lit(parts)) == no)


def fits_broadcast(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; stops counting beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def _file_bytes(spark: SparkSession, files: list[str]) -> int:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def sorted_parts(df: DataFrame) -> int | None:
    """How many parts to sort the rows of ``df`` in, so that a task's stay as many as the files grow.

    None if the session's number of shuffle partitions will do. Only the list of files is looked at.
    """
    spark = df.sparkSession
    parts = _file_bytes(spark, df.inputFiles()) // SORTED_BYTES
    if parts <= spark.sparkContext.defaultParallelism:
        return None
    return max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def shuffled_in(spark: SparkSession, parts: int | None) -> Iterator[None]:
    """Run what is written inside with so many shuffle partitions, none put together, if a number is given."""
    wanted = {"spark.sql.shuffle.partitions": parts, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in wanted}
    if parts is not None:
        for key, value in wanted.items():
            spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def spread(df: DataFrame) -> DataFrame:
    """Give a costly per-row step all cores when its input has fewer files than that.

    A few large files give more tasks than there are cores, so that a task's rows stay
    as many as the input grows. A table of many files passes unchanged. Only the list
    of files is looked at, nothing runs.
    """
    spark, files = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if len(files) >= cores:
        return df
    return df.repartition(max(cores, _file_bytes(spark, files) // SPREAD_BYTES))

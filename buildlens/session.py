"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# The folder for scratch inside a scratch_scope.
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("buildlens")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach, as the session names it in spark.checkpoint.dir."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="buildlens-")
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy.

    A written table survives lost executors as a checkpoint does, keeps its columns prunable and
    tells the optimizer its size.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_buckets(df: DataFrame, *keys: str) -> DataFrame:
    """Write ``df`` to the shared folder in as many buckets of ``keys`` as shuffles have partitions.

    Joins and aggregates by these keys bring the other side to the written rows, however often: a table
    with long texts is shuffled once.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "buckets")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    dealt = df.repartition(parts, *keys).write.format("parquet").option("compression", "zstd").option("path", path)
    dealt.bucketBy(parts, *keys).saveAsTable(name)
    return spark.table(name)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    Spark sizes an exploded table as the one it came from and a written table by its compressed files, so
    one far larger than the broadcast threshold may seem small. For sides that grow with the input.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str, per_core: int | None = None, least: int = 0) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as shuffles have, however few bytes they hold.

    Adaptive execution merges partitions by their compressed size, which says little of the memory or work of
    rows that compress well or are exploded next; partitions asked for by number stay. Rows that need all
    cores but no small partitions take ``per_core`` at most; few rows that are much work take ``least`` a core.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if per_core is not None:
        parts = min(parts, per_core * spark.sparkContext.defaultParallelism)
    parts = max(parts, least * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, or in the folder of the scope that is open."""
    folder = _SCOPE.get() or shared_dir(spark).rstrip("/")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whichever that is."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch that is written inside is deleted at the end: what reads it must be written by then."""
    folder = scratch_path(spark, "scope")
    token = _SCOPE.set(folder)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        remove(spark, folder)

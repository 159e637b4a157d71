"""Surrogate keys without a global counter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 3


def issue_key(run_id: Column, field: Column, artifact_id: Column, tag_id: Column, start: Column) -> Column:
    """Fixed-width text whose order is (run, field, artifact, tag, start).

    A tag's matches in one text never overlap, so the start makes the key unique; tagging the
    same run again gives the same keys, which makes a repeated write harmless.
    """
    part = lambda c, width: F.lpad(F.coalesce(c, F.lit(0)).cast("string"), width, "0")
    return F.concat_ws(
        "-", part(run_id, 19), part(field, 1), part(artifact_id, 19), part(tag_id, 19), part(start, 10)
    )


def assign_ids(df: DataFrame, key: str, id_col: str, after: DataFrame | None = None) -> DataFrame:
    """Number rows densely from 1 (or from the single value in ``after`` plus 1).

    ``key`` is unique text. Rows are numbered by (first digits of its md5, key): the digits give
    evenly filled buckets whatever the keys look like, every bucket is numbered on its own, and
    only the bucket sizes, at most 16 ** BUCKET_DIGITS rows, are summed in one place. ``after`` is a one-row, one-column DataFrame.
    """
    bucketed = df.withColumn("_bucket", F.substring(F.md5(F.col(key)), 1, BUCKET_DIGITS))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    if after is not None:
        top = F.coalesce(F.col(after.columns[0]), F.lit(0)).cast("long")
        sizes = sizes.unionByName(after.select(F.lit("").alias("_bucket"), top.alias("_n")))
    offsets = sizes.select(
        "_bucket",
        (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_offset"),
    )
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (
        bucketed.withColumn("_rank", rank)
        .join(offsets, "_bucket")
        .withColumn(id_col, (F.col("_offset") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_rank", "_offset")
    )


def ordered_ids(df: DataFrame, order: str, id_col: str) -> DataFrame:
    """Long ids that follow ``order`` (unique), not dense; cut the lineage right after.

    A range shuffle gives every partition its own slice of the order, so partition number and
    position together already rise with it.
    """
    return (
        df.repartitionByRange(order)
        .sortWithinPartitions(order)
        .withColumn(id_col, F.monotonically_increasing_id())
    )

"""Numbering rows in order and cutting them into chunks, without a single-task window."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill import contract as C
from recordmill.plans.pins import pin


ROWS_PER_SLICE = 1_000_000


def slices_for(rows: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> int:
    """How many range slices keep each at about ``rows_per_slice``; all cores at least. Counts the rows."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // rows_per_slice))


def range_sliced(df: DataFrame, order: list[str], rows_per_slice: int = ROWS_PER_SLICE, slices: int | None = None) -> DataFrame:
    """``df``, written in ranges of ``order`` of about ``rows_per_slice`` rows, with the range as ``_slice``.

    Spark samples the bounds of the ranges; what is counted and sampled is written first, not computed each time.
    """
    if slices is None:
        df = pin(df)
        slices = slices_for(df, rows_per_slice)
    return pin(df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()))


def numbered_batches(df: DataFrame, order: str, size: int = C.BATCH_SIZE, slices: int | None = None,
                     rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Adds ``ordinal`` (from 1, in ``order``, which is unique) and ``batch_no`` (from 0).

    Rows are written, counted and cut into ranges of about ``rows_per_slice``, whose bounds Spark samples, and
    written with their slice number, so that every later reading agrees on the slices. Each slice is numbered in itself
    and shifted by the rows of the slices before it: one count per slice.
    """
    if size <= 0:
        raise ValueError("chunk size must be greater than zero")
    sliced = range_sliced(df, [order], rows_per_slice, slices)
    counts = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
    # one row per slice, so this window sees at most n rows
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(
        F.col("_slice").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift")
    )
    within = W.partitionBy("_slice").orderBy(order)
    return (
        sliced.join(F.broadcast(shifts), F.col("_slice") == F.col("_of"))
        .withColumn("ordinal", F.row_number().over(within) + F.col("_shift"))
        .withColumn("batch_no", F.floor((F.col("ordinal") - 1) / size))
        .drop("_slice", "_of", "_shift")
    )

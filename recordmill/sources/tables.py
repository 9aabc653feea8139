"""Parquet tables."""

from pyspark.sql import DataFrame, SparkSession

#: Files of this many bytes a task hold row groups enough for all tasks.
BYTES_PER_TASK = 16 << 20


def read_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A table as it lies, or dealt out to ``partitions`` tasks where its files hold too few row groups for the work.

    Large files are split as they are read; dealing them out would shuffle and sort the whole table.
    """
    table = spark.read.parquet(path)
    return table if partitions is None or table_bytes(spark, path) >= partitions * BYTES_PER_TASK else table.repartition(partitions)


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a table's files."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()

"""Column expressions and row selection that several operators share."""

import pickle
import string
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.plans.pins import pin


BATCH_ROWS = 1000


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of texts, which reach Python tasks at most ``BATCH_ROWS`` at a time, as some are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(path)


def sent(spark: SparkSession, value: Any) -> Broadcast[bytes]:
    """``value`` for all tasks, with the classes it is made of: executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast[bytes]) -> Any:
    return pickle.loads(shared.value)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, in lower-case hex."""
    return F.sha2(ascii_lower(text).cast("binary"), 256)


def keep_one_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text digest stand in ``kept(doc_id, text_sha256)``, one row for each.

    Ids may be null or repeat; only rows that agree in both id and text (up to A-Z) are
    taken for copies of one another, and then one of them stays. ``kept`` has a row per
    kept document; all columns of ``docs`` are returned.
    """
    columns = [F.col("doc").getField(c).alias(c) for c in docs.columns]
    mine = docs.select(  # the columns in a struct, so none of them is taken for those added
        F.struct("*").alias("doc"), F.col("doc_id").alias("_id"), digest(F.col("text")).alias("_digest"))
    keys = kept.select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_digest"))
    match = F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_digest") == F.col("_kept_digest"))
    stay = mine.join(keys, match, "left_semi")
    repeated = pin(mine.groupBy("_id", "_digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("_id").alias("_kept_id"), F.col("_digest").alias("_kept_digest")))
    if repeated.isEmpty():
        return stay.select(*columns)
    once = stay.join(repeated, match, "left_semi").dropDuplicates(["_id", "_digest"])
    return stay.join(repeated, match, "left_anti").select(*columns).unionByName(once.select(*columns))

"""Predicates over whole rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill import contract as C


def is_blank(df: DataFrame, ignored: tuple[str, ...] = ()) -> Column:
    """True when no field holds data; the id, the modification time and the write-back are no data."""
    system = {"record_id", C.MODIFIED, C.KNOWN_ID, *ignored}
    blank = F.lit(True)
    for f in df.schema.fields:
        if f.name in system:
            continue
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            blank = blank & (F.coalesce(F.size(value), F.lit(0)) <= 0)
        elif isinstance(f.dataType, T.StringType):
            blank = blank & (F.coalesce(value, F.lit("")) == "")
        else:
            blank = blank & value.isNull()
    return blank


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Key values held by more than one row, with their count: uniqueness checks, repeated names."""
    return (
        df.where(F.col(keys[-1]).isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )


def first_broken(constraints: list[tuple[Column, str]]) -> Column:
    """Reason of the first constraint of the target that a row breaks, or null."""
    reason = F.lit(None).cast("string")
    for broken, text in reversed(constraints):
        reason = F.when(F.coalesce(broken, F.lit(False)), F.lit(text)).otherwise(reason)
    return reason

"""Idempotent upsert: changes folded per record, then merged property by property."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill import contract as C


def target_columns(object_type: str) -> list[str]:
    return ["id", *C.PROPERTIES[object_type], *C.STAMPS]


def fold_changes(rows: DataFrame, object_type: str, order: tuple[str, ...] = ("seq", "record_id")) -> DataFrame:
    """One change per target record: of each property the last value given, in ``order``.

    ``order`` names columns that leave no ties, so that a retry gives the same. Expects
    ``target_id`` and ``props``; a row without a target changes nothing. An aggregate, so that a record with very
    many changes is combined before the shuffle. Rows that give every property are compared whole, so their order is moved
    once and not with each property; the others by property.
    """
    names = [*C.PROPERTIES[object_type], *C.STAMPS]
    at = F.struct(*order).alias("at")
    value = {name: F.col(f"props.{name}") for name in names}
    full = reduce(Column.__and__, [v.isNotNull() for v in value.values()])
    every = F.struct(at, *[v.alias(f"of_{name}") for name, v in value.items()])
    folded = rows.where(F.col("target_id").isNotNull()).groupBy(F.col("target_id").alias("id")).agg(
        F.max(F.when(full, every)).alias("_full"),
        *[F.max(F.when(~full & v.isNotNull(), F.struct(at, v.alias("of")))).alias(f"_{name}") for name, v in value.items()])
    return folded.select("id", *[
        F.when(F.col("_full").isNull() | (F.col(f"_{name}.at") > F.col("_full.at")), F.col(f"_{name}.of"))
        .otherwise(F.col(f"_full.of_{name}")).alias(name)
        for name in names])


def merge(target: DataFrame, changes: DataFrame, object_type: str, how: str = "full") -> DataFrame:
    """The target after the changes, with ``action`` (null for untouched records).

    A property the change does not give keeps its value. Nothing is deleted.
    ``how="right"`` gives the touched records only.
    """
    names = [*C.PROPERTIES[object_type], *C.STAMPS]
    old, new = target.alias("old"), changes.alias("new")
    return old.join(new, F.col("old.id") == F.col("new.id"), how).select(
        F.coalesce("new.id", "old.id").alias("id"),
        *[F.coalesce(f"new.{n}", f"old.{n}").alias(n) for n in names],
        F.when(F.col("new.id").isNull(), F.lit(None))
        .when(F.col("old.id").isNull(), F.lit(C.CREATED))
        .otherwise(F.lit(C.UPDATED)).alias("action"),
    )


def write_backs(rows: DataFrame) -> DataFrame:
    """``(record_id, target_id)`` of the rows whose stored id would change."""
    return rows.where(F.coalesce("known_id", F.lit("")) != F.col("target_id")).select(
        "record_id", "target_id"
    ).distinct()


def apply_write_backs(source: DataFrame, backs: DataFrame) -> DataFrame:
    """The source with the new ids stored; the modification time stays, so nothing is re-triggered."""
    kept = [c for c in source.columns if c != C.KNOWN_ID]
    return source.join(backs, "record_id", "left").select(
        *kept, F.coalesce("target_id", C.KNOWN_ID).alias(C.KNOWN_ID)
    ).select(*source.columns)

"""Associations between records: a set of directed edges."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill import contract as C

EDGE = ["from_type", "from_id", "to_type", "to_id"]


def pairs(staged: DataFrame, from_type: str, to_type: str, key: str, fk: str, link: str) -> DataFrame:
    """One row per reference: both ids, or the reason why there is no edge.

    ``staged`` carries its own ``target_id`` and, as ``link``, the id of the record it refers to.
    """
    reason = F.when(
        F.col("target_id").isNull(), F.lit(C.NOT_MIGRATED_FROM.replace("{type}", from_type))
    ).when(
        F.col(link).isNull(),
        F.concat(F.lit(f"{to_type} record "), F.col(fk), F.lit(" was not migrated")),
    )
    return staged.where(F.coalesce(F.col(fk), F.lit("")) != "").select(
        F.lit(f"{from_type}->{to_type}").alias("label"),
        F.lit(from_type).alias("from_type"), F.col("target_id").alias("from_id"),
        F.lit(to_type).alias("to_type"), F.col(link).alias("to_id"),
        F.col(key).alias("from_key"), F.col(fk).alias("to_key"), reason.alias("reason"),
    )


def edge(from_type: str, from_id: Column, to_type: str, to_id: Column) -> list[Column]:
    return [
        F.lit(from_type).alias("from_type"), from_id.alias("from_id"),
        F.lit(to_type).alias("to_type"), to_id.alias("to_id"),
    ]


def add_edges(existing: DataFrame, asserted: DataFrame) -> DataFrame:
    """Union as a set: asserting an edge again changes nothing."""
    return existing.select(*EDGE).unionByName(asserted.select(*EDGE)).distinct()


def new_edges(existing: DataFrame, asserted: DataFrame) -> DataFrame:
    """Only the edges to append."""
    return asserted.select(*EDGE).distinct().join(existing.select(*EDGE), EDGE, "left_anti")

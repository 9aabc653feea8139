"""Skew-safe lookups: every child row finds at most one parent row by key.

A plain left join sends all rows of one key to one task, and all rows without a
key to one task too. Here

* rows without a key are spread by their own identity: they match nothing;
* a key with more than ``rows_per_task`` rows is split into as many parts as it
  needs; the one parent row of such a key is repeated once per part.

Hot keys are found when a lookup is built. Rows are counted by the hash of their key first, so what is
shuffled is a bounded number of counts and not the keys; the keys themselves are counted in those hashes only
that have more rows than a task may get. The table of hot keys is broadcast. Its size is bounded by construction:
it has at most ``rows / rows_per_task`` entries of one key and one number each. Where there is none, parts play no role and the join is by the key alone.

``spark.recordmill.rowsPerTask`` in the session sets how many rows of one key a task may get.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_TASK = 2_000_000
NULL_SPREAD = 1 << 16
HASHES = 1 << 16
#: The driver builds the table of keys that are broadcast in its own memory: so many bytes at most, and so many a key beside its text.
BROADCAST_BYTES = 64 << 20
KEY_BYTES = 96


def rows_per_task_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.recordmill.rowsPerTask", str(ROWS_PER_TASK)))


def hot_keys(rows: DataFrame, key: Column, rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """``(_hot, _parts)``: keys held by too many rows; None if there is none.

    A key's rows all have one hash, so a key with too many is in a hash with too many.
    """
    keys = rows.select(key.alias("_hot")).where(F.col("_hot").isNotNull())
    hashed = F.pmod(F.xxhash64("_hot"), F.lit(HASHES)).cast("int")
    full = keys.groupBy(hashed.alias("_hash")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_task).select(
        "_hash").collect()  # rows / rows_per_task at most
    if not full:
        return None
    spark = rows.sparkSession
    suspects = F.broadcast(spark.createDataFrame([(r["_hash"],) for r in full], "_hash int"))
    hot = (
        keys.join(suspects, hashed == F.col("_hash"), "left_semi")
        .groupBy("_hot")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows_per_task)
        .select("_hot", F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_parts"))
    )
    found = [tuple(r) for r in hot.collect()]
    return spark.createDataFrame(found, hot.schema) if found else None


def lookup(
    children: DataFrame,
    parents: DataFrame,
    key: Column,
    parent_key: str,
    take: dict[str, str],
    spread: list[str],
    counted: tuple[DataFrame, Column] | None = None,
    rows_per_task: int | None = None,
    apart: bool = False,
) -> DataFrame:
    """``children`` plus the columns ``take`` (new name -> parent column), null where not found.

    ``parents`` has one row per ``parent_key``. ``spread`` names columns that
    tell child rows apart. ``counted`` is a cheaper frame, and the key in it, to
    find hot keys with, when the children are the result of a long plan; it may
    count more rows than the children have. With ``apart`` rows without a key are not moved at all, which
    reads the children twice: for pinned ones.
    """
    if apart:
        found = lookup(children.where(key.isNotNull()), parents, key, parent_key, take, spread, counted, rows_per_task)
        kinds = {name: parents.schema[c].dataType for name, c in take.items()}
        return found.unionByName(children.where(key.isNull()).withColumns({n: F.lit(None).cast(k) for n, k in kinds.items()}))
    counted, counted_key = counted or (children, key)
    wanted = parents.select(
        F.col(parent_key).alias("_parent_key"), *[F.col(c).alias(name) for name, c in take.items()]
    ).where(F.col("_parent_key").isNotNull())
    hot = hot_keys(counted, counted_key, rows_per_task or rows_per_task_of(children))
    own = F.xxhash64(*spread)
    text = children.select(key).schema.fields[0].dataType == wanted.schema["_parent_key"].dataType == T.StringType()
    if hot is None and text:
        # rows without a key go where a text of their own leads, which counts as no key; no copy of the key is moved for it
        at = F.coalesce(key, F.pmod(own, F.lit(NULL_SPREAD)).cast("string"))
        return children.join(wanted, (at == F.col("_parent_key")) & key.isNotNull(), "left").drop("_parent_key")
    keyed = children.withColumn("_key", key)
    salt = F.when(F.col("_key").isNull(), F.pmod(own, F.lit(NULL_SPREAD)))
    if hot is None:
        repeated = wanted.withColumn("_parent_salt", F.lit(0))
    else:
        # at most rows / rows_per_task entries
        hot = F.broadcast(hot)
        keyed = keyed.join(hot, F.col("_key") == hot["_hot"], "left")
        salt = salt.when(F.col("_parts").isNotNull(), F.pmod(own, F.col("_parts")))
        repeated = wanted.join(hot, F.col("_parent_key") == hot["_hot"], "left").withColumn(
            "_parent_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
        ).drop("_hot", "_parts")
    salted = keyed.withColumn("_salt", salt.otherwise(F.lit(0)).cast("int")).drop("_hot", "_parts")
    return salted.join(
        repeated,
        (F.col("_key") == F.col("_parent_key")) & (F.col("_salt") == F.col("_parent_salt")),
        "left",
    ).drop("_key", "_salt", "_parent_key", "_parent_salt")


def first_by(rows: DataFrame, key: Column, order: str | list[str], keep: list[str]) -> DataFrame:
    """One row per key, the one lowest in ``order`` (columns that leave no ties), as ``(first_key, *keep)``.

    An aggregate and not a window: copies of a hot key are combined before the shuffle.
    """
    order = [order] if isinstance(order, str) else order
    ordered = rows.select(key.alias("first_key"), F.struct(*order).alias("_order"), F.struct(*keep).alias("_kept"))
    # columns that are part of the order are not moved twice
    kept = F.min("_order") if set(keep) <= set(order) else F.min_by("_kept", "_order")
    return (
        ordered.where(F.col("first_key").isNotNull())
        .groupBy("first_key")
        .agg(kept.alias("_kept"))
        .select("first_key", *[F.col(f"_kept.{c}").alias(c) for c in keep])
    )


def few(rows: DataFrame) -> bool:
    """Whether ``rows`` (one column) are so few, and so short, that their keys can be broadcast.

    Each task counts its own; a limit would move up to that many rows of every task to one.
    """
    length = F.octet_length(F.col(rows.columns[0]).cast("string"))
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")).first()
    return size["rows"] * KEY_BYTES + size["bytes"] <= BROADCAST_BYTES


def relevant(parents: DataFrame, parent_key: str, keys: DataFrame, exact: bool = True) -> DataFrame:
    """Only the parents some key asks for.

    A small set of keys is counted first and broadcast, so that a large table is filtered where it is read. Left to
    itself the join is planned before that is known, and shuffles the table. Without ``exact`` a table
    that many keys ask for stays whole, for a join that follows anyway.
    """
    keys = keys.toDF("_asked").where(F.col("_asked").isNotNull())
    small = few(keys)
    if not (small or exact):
        return parents
    asked = F.broadcast(keys.distinct()) if small else keys.distinct()
    return parents.join(asked, parents[parent_key] == asked["_asked"], "left_semi")

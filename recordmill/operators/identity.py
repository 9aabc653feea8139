"""Which target record is a source row? Existing ones by three tiers, new ones by a stable id."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill import contract as C
from recordmill.operators.lookup import first_by, lookup, relevant
from recordmill.plans.pins import pin


def new_id(external_id: Column, salt: str = "") -> Column:
    """Id of a record to be created: a function of its external id, so that a retry gives the same."""
    text = F.concat(external_id, F.lit(salt)) if salt else external_id
    return F.substring(F.sha2(text, 256), 1, 32)


def match_external(rows: DataFrame, target: DataFrame, external: Column, spread: list[str],
                   counted: tuple[DataFrame, Column] | None = None) -> DataFrame:
    """Adds ``existing_id``: the target record that carries the row's external id."""
    known = first_by(target, F.col(C.EXTERNAL_ID), "id", ["id"])
    return lookup(rows, known, external, "first_key", {"existing_id": "id"}, spread, counted)


def three_tiers(rows: DataFrame, target: DataFrame, natural: str | None) -> DataFrame:
    """Adds ``existing_id`` and ``matched_by``.

    Expects ``record_id``, ``known_id``, ``external_id`` and ``natural_key``.
    ``natural`` names the target's natural key, if it has one. A stored id counts only while its record exists. Each tier looks up just the
    rows that the tiers before it left open.
    """
    spread = ["record_id"]

    def asked(key: str, by: str) -> DataFrame:
        return relevant(target, key, rows.select(by), exact=False)

    # rows without a stored id have nothing to look up in the first tier and are not moved for it
    stored = F.col("known_id").isNotNull()
    found = lookup(rows.where(stored), asked("id", "known_id"), F.col("known_id"), "id", {"_t1": "id"}, spread).unionByName(
        rows.where(~stored).withColumn("_t1", F.lit(None).cast(target.schema["id"].dataType)))
    still = F.when(F.col("_t1").isNull(), F.col("external_id"))
    known = first_by(asked(C.EXTERNAL_ID, "external_id"), F.col(C.EXTERNAL_ID), "id", ["id"])
    found = lookup(found, known, still, "first_key", {"_t2": "id"}, spread,
                   (rows, F.col("external_id")))
    if natural:
        open_key = F.when(F.coalesce("_t1", "_t2").isNull(), F.col("natural_key"))
        adopted = first_by(asked(natural, "natural_key"), F.col(natural), "id", ["id"])
        found = lookup(found, adopted, open_key, "first_key", {"_t3": "id"}, spread,
                       (rows, F.col("natural_key")))
    else:
        found = found.withColumn("_t3", F.lit(None).cast("string"))
    return found.withColumn("existing_id", F.coalesce("_t1", "_t2", "_t3")).withColumn(
        "matched_by",
        F.when(F.col("_t1").isNotNull(), F.lit(C.BY_KNOWN_ID))
        .when(F.col("_t2").isNotNull(), F.lit(C.BY_EXTERNAL_ID))
        .when(F.col("_t3").isNotNull(), F.lit(C.BY_NATURAL_KEY)),
    ).drop("_t1", "_t2", "_t3")


def free_ids(new: DataFrame, taken: Callable[[DataFrame], DataFrame], salt: str) -> DataFrame | None:
    """``(external_id, id)`` of the external ids whose own id is taken, with the first free id; None if there are none.

    ``new`` holds external ids, ``taken`` gives those of some ids (column ``id``) that exist, and maybe others. Candidates are
    derived from the external id, then with ``salt``, then with salt and a number. Each
    round asks for the rows whose last candidate was taken, usually none after the first.
    """
    found: DataFrame | None = None
    left, turn = new.select("external_id").where(F.col("external_id").isNotNull()), 0
    while True:
        extra = "" if turn == 0 else f"@{salt}" if turn == 1 else f"@{salt}#{turn}"
        tried = left.select("external_id", new_id(F.col("external_id"), extra).alias("id"))
        tried = tried if turn == 0 else pin(tried)
        held = pin(tried.join(taken(tried.select("id")), "id", "left_semi").distinct())  # hardly any
        if turn:
            free = tried.join(held, ["external_id", "id"], "left_anti")
            found = free if found is None else found.unionByName(free)
        if held.isEmpty():
            return found
        left, turn = held, turn + 1


def none_taken(rows: DataFrame, target: DataFrame) -> bool:
    """Whether the target holds no row's own id. Compared by hashes, eight bytes an id; equal hashes of two ids count as held."""
    own = rows.where(F.col("external_id").isNotNull()).select(F.xxhash64(new_id(F.col("external_id"))).alias("_own"))
    return relevant(target.select(F.xxhash64("id").alias("_held")), "_held", own).isEmpty()


def resolve(rows: DataFrame, target: DataFrame, natural: str | None, salt: str = "",
            taken: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``target_id``, ``action`` and ``matched_by`` to rows with one row per record.

    New rows that share a natural key become one record: the first of them in
    ``seq`` creates it, the others adopt it. An id that a re-stamped record
    already holds is derived again, with ``salt`` (the batch) and then numbers, until it is free.
    ``taken`` tells which ids exist where ``target`` is only a part of the target.
    """
    matched = three_tiers(rows, target, natural)
    is_open = F.col("existing_id").isNull()
    own = new_id(F.col("external_id"))
    if natural is None and taken is None and none_taken(rows, target):
        other = None  # every step below reads the matched rows once, so they are not written
    else:
        taken = taken or (lambda ids: relevant(target.select("id"), "id", ids, exact=False))
        matched = pin(matched)
        other = free_ids(matched.where(is_open), taken, salt)
    if other is None:
        checked = matched.withColumn("_own", own)
    else:
        checked = lookup(matched, other.withColumnRenamed("external_id", "_external"), F.when(is_open, F.col("external_id")),
                         "_external", {"_free": "id"}, ["record_id"])
        checked = checked.withColumn("_own", F.coalesce("_free", own)).drop("_free")
    if natural:
        leaders = first_by(checked.where(is_open), F.col("natural_key"), ["seq", "record_id"], ["external_id", "_own"])
        led = lookup(checked, leaders, F.when(is_open, F.col("natural_key")), "first_key",
                     {"_leader": "external_id", "_led": "_own"}, ["record_id"],
                     (rows, F.col("natural_key")))
    else:
        nothing = F.lit(None).cast("string")
        led = checked.withColumn("_leader", nothing).withColumn("_led", nothing)
    follows = is_open & F.coalesce(F.col("_leader") != F.col("external_id"), F.lit(False))
    return (
        led.withColumn("target_id", F.coalesce("existing_id", "_led", "_own"))
        .withColumn("action", F.when(is_open & ~follows, F.lit(C.CREATED)).otherwise(F.lit(C.UPDATED)))
        .withColumn(
            "matched_by", F.when(follows, F.lit(C.BY_NATURAL_KEY)).otherwise(F.col("matched_by"))
        )
        .drop("_own", "_leader", "_led", "existing_id")
    )


def find_parents(children: DataFrame, parents: DataFrame, link: Column, business_key: Column | None,
                 parent_key: str | None) -> DataFrame:
    """Adds ``parent_record`` and ``parent_known_id``: by link first, then by business key.

    Expects ``work_key`` on the children. The business key is compared as text,
    and the first parent in record order wins.
    """
    parents = parents.withColumn(C.KNOWN_ID, F.nullif(C.KNOWN_ID, F.lit("")))
    linked = children.withColumn("_link", link)
    linked = lookup(linked, parents, F.col("_link"), "record_id",
                    {"_p1": "record_id", "_k1": C.KNOWN_ID}, ["work_key"],
                    (children, link), apart=True)
    if business_key is None:
        return linked.withColumnsRenamed({"_p1": "parent_record", "_k1": "parent_known_id"}).drop("_link")
    by_key = first_by(parents, F.nullif(F.col(parent_key).cast("string"), F.lit("")), "record_id",
                      ["record_id", C.KNOWN_ID])
    open_key = F.when(F.col("_p1").isNull(), F.nullif(business_key.cast("string"), F.lit("")))
    keyed = lookup(linked, by_key, open_key, "first_key", {"_p2": "record_id", "_k2": C.KNOWN_ID},
                   ["work_key"],
                   (children, F.nullif(business_key.cast("string"), F.lit(""))))
    return (
        keyed.withColumn("parent_record", F.coalesce("_p1", "_p2"))
        .withColumn("parent_known_id", F.when(F.col("_p1").isNotNull(), F.col("_k1")).otherwise(F.col("_k2")))
        .drop("_link", "_p1", "_k1", "_p2", "_k2")
    )

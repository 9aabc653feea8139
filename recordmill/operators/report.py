"""Tallies, summaries and problem files of a run."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill import contract as C
from recordmill.operators.batches import range_sliced
from recordmill.plans.migrate import Migration

STATUSES = [C.CREATED, C.UPDATED, C.REJECTED, C.FAILED]


def _types(spark: SparkSession) -> DataFrame:
    """The four object types, in order: a tally names each of them, rows or not."""
    return spark.createDataFrame(list(enumerate(C.OBJECT_TYPES)), "scan_order int, object_type string")


def stage_counts(run: Migration) -> DataFrame:
    """One row per entity, from one pass over its staged frame."""
    parts = []
    for object_type, frame in run.staged.items():
        asked = {
            p: F.coalesce(F.col(fk), F.lit("")) != "" for p, fk in run.specs[object_type].parents.items()
        }
        met = {p: F.col("target_id").isNotNull() & F.col(f"to_{p}").isNotNull() for p in asked}
        missing = [F.count_if(asked[p] & ~met[p]) for p in asked]
        parts.append(frame.agg(
            F.count(F.lit(1)).alias("source_rows"),
            *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
            F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("bigint").alias("warnings"),
            (reduce(lambda a, b: a + b, missing) if missing else F.lit(0)).cast("bigint").alias("missing_associations"),
            *[F.count_if(asked[p] & met[p]).alias(f"to_{p}") if p in asked else F.lit(0).cast("bigint").alias(f"to_{p}")
              for p in (C.COMPANIES, C.CONTACTS)],
        ).withColumn("object_type", F.lit(object_type)))
    return reduce(DataFrame.unionByName, parts)


def tallies(run: Migration) -> DataFrame:
    """Created, updated, rejected and failed per object type, zeros included."""
    counts = stage_counts(run)
    spark = counts.sparkSession
    return _types(spark).join(F.broadcast(counts), "object_type", "left").select(
        "object_type", *[F.coalesce(s, F.lit(0)).cast("bigint").alias(s) for s in STATUSES]
    )


def association_counts(references: DataFrame) -> DataFrame:
    """Edges written, or that would be written, per kind."""
    label = F.lit(None).cast("string")
    for (a, b), text in C.EDGE_LABELS.items():
        label = F.when((F.col("from_type") == a) & (F.col("to_type") == b), F.lit(text)).otherwise(label)
    return (
        references.where(F.col("reason").isNull()).groupBy(label.alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def summary(run: Migration) -> DataFrame:
    """The run in one row."""
    per = stage_counts(run)
    of = lambda t, c: F.coalesce(F.sum(F.when(F.col("object_type") == t, F.col(c))), F.lit(0))
    total = lambda c: F.sum(c)
    return per.agg(
        *[of(t, "source_rows").alias(f"{t}_rows") for t in (C.COMPANIES, C.CONTACTS, C.DEALS)],
        *[of(t, s).alias(f"{t}_{s}") for t in C.OBJECT_TYPES for s in (C.CREATED, C.UPDATED)],
        of(C.CONTACTS, f"to_{C.COMPANIES}").alias("contact_to_company"),
        of(C.DEALS, f"to_{C.COMPANIES}").alias("deal_to_company"),
        of(C.DEALS, f"to_{C.CONTACTS}").alias("deal_to_contact"),
        total(C.REJECTED).alias("rejected"), total(C.FAILED).alias("failed"),
        total("warnings").alias("warnings"), total("missing_associations").alias("missing_associations"),
        (total(C.REJECTED) + total(C.FAILED) > 0).alias("has_problems"),
    ).withColumn("run_id", F.lit(run.run_id))


def problem_rows(run: Migration) -> DataFrame:
    """Rejections and failures with the union of the original columns, for correction and re-import."""
    return run.rejections().unionByName(run.failures(), allowMissingColumns=True)


def write_json(run: Migration, folder: str) -> None:
    """One JSON dataset per section of the report."""
    sections = {
        "summary": summary(run), "rejections": run.rejections(), "failures": run.failures(),
        "warnings": run.warnings(), "missing_associations": run.missing_associations(),
    }
    for name, frame in sections.items():
        frame.write.mode("overwrite").json(f"{folder}/{name}")


def write_problem_csv(run: Migration, folder: str) -> bool:
    """The problem rows as CSV; no file when there is no problem."""
    rows = problem_rows(run)
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", "").option("nullValue", "").csv(folder)
    return True


def rescan_tally(outcomes: DataFrame) -> DataFrame:
    """Scanned, synced, skipped and failed of one rescan."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("scanned"),
        *[F.count_if(F.col("status") == s).alias(s) for s in (C.SYNCED, C.SKIPPED, C.FAILED)],
    )


def observed_tally(outcomes: DataFrame) -> tuple[DataFrame, Observation]:
    """The outcomes, and the figures of ``rescan_tally`` as an observation that the next write of them fills."""
    observation = Observation()
    return outcomes.observe(
        observation, F.count(F.lit(1)).alias("scanned"),
        *[F.count_if(F.col("status") == s).alias(s) for s in (C.SYNCED, C.SKIPPED, C.FAILED)]), observation


def permanent_failures(outcomes: DataFrame) -> DataFrame:
    """Failed outcomes that no retry changes, by code; the others will be tried again by the next scan."""
    return outcomes.where((F.col("status") == C.FAILED) & F.col("permanent")).groupBy("entity", "code").agg(
        F.count(F.lit(1)).alias("n"))


def percentiles(rows: DataFrame, keys: list[str], value: str, parts: dict[str, float]) -> DataFrame:
    """``(*keys, *parts)``: exact percentiles of ``value`` per key, linear between neighbours; nulls do not count.

    Rows are first counted per key and value. The distinct values are dealt out in ranges, so that a key with very many
    of them is many tasks' work, and a value's rank is its count within the range plus those of the
    ranges before it.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.struct(*keys).alias("_key"), F.col(value).alias("_value")).agg(
        F.count(F.lit(1)).alias("_n"))
    sliced = range_sliced(counted, ["_key", "_value"])
    whole = W.partitionBy("_of")
    before = whole.orderBy("_in").rowsBetween(W.unboundedPreceding, -1)
    shifts = sliced.groupBy(F.col("_key").alias("_of"), F.col("_slice").alias("_in")).agg(F.sum("_n").alias("_rows")).select(
        "_of", "_in", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("_total"))
    within = W.partitionBy("_slice", "_key").orderBy("_value").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = sliced.withColumn("_end", F.sum("_n").over(within)).join(
        shifts, (F.col("_key") == F.col("_of")) & (F.col("_slice") == F.col("_in")))
    end = F.col("_before") + F.col("_end")
    start = end - F.col("_n")

    def at(rank: Column) -> Column:
        return F.max(F.when((start <= rank) & (rank < end), F.col("_value").cast("double")))

    places = {name: (F.col("_total") - 1) * F.lit(part).cast("double") for name, part in parts.items()}
    picked = ranked.groupBy("_key").agg(
        F.max("_total").alias("_total"), *[at(F.floor(p)).alias(f"_low_{name}") for name, p in places.items()],
        *[at(F.ceil(p)).alias(f"_high_{name}") for name, p in places.items()])
    return picked.select(*[F.col(f"_key.{k}").alias(k) for k in keys], *[
        (F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (p - F.floor(p))).alias(name)
        for name, p in places.items()])


def attempt_signals(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts per ``keys`` (such as action and type): how many, retried after 429, and exact duration percentiles.

    Expects ``status`` and ``duration`` (any unit).
    """
    counts = attempts.groupBy(F.struct(*keys).alias("_key")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == 429).alias("throttled"))
    found = percentiles(attempts, keys, "duration", {f"p{p}": p / 100 for p in (50, 95, 99)})
    found = found.select(F.struct(*keys).alias("_of"), "p50", "p95", "p99")
    return counts.join(found, F.col("_key") == F.col("_of"), "left").select(
        *[F.col(f"_key.{k}").alias(k) for k in keys], "attempts", "throttled", "p50", "p95", "p99")


def signals(outcomes: DataFrame) -> DataFrame:
    """Operating signals over an outcome log, per entity: faults that are no bad data, parents not found."""
    return outcomes.groupBy("entity").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("code").isNotNull() & (F.col("code") != C.VALIDATION_ERROR)).alias("faults"),
        F.count_if(F.col("code") == C.VALIDATION_ERROR).alias("bad_data"),
        F.count_if(F.coalesce(F.col("parent_missing"), F.lit(False))).alias("unresolved_parents"),
    )

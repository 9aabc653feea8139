"""Bulk migration: three CSV entities, parents first, into the target.

Each entity becomes one *staged* frame: its rows with mapped properties, status,
reason, warnings, their own target id and the ids of the records they refer to.
Rejections, warnings, changes, edges and tallies are projections and aggregates
of staged frames; no row is ever looked at twice for them.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill import contract as C
from recordmill.functions import external_id, message
from recordmill.operators import edges as E
from recordmill.operators import merge as M
from recordmill.operators.identity import match_external, new_id
from recordmill.operators.lookup import lookup
from recordmill.operators.mapping import CSV_SPECS, CsvSpec
from recordmill.operators.validate import first_broken
from recordmill.plans.pins import pin

Constraints = dict[str, list[tuple[Column, str]]]


def stage(
    rows: DataFrame,
    spec: CsvSpec,
    id_maps: dict[str, DataFrame],
    target: DataFrame | None,
    import_orphans: bool = True,
    dry_run: bool = False,
    constraints: list[tuple[Column, str]] = (),
) -> DataFrame:
    """Rows of one entity with ``status, reason, warnings, props, target_id, to_<type>``."""
    staged = rows.withColumn("source_id", F.nullif(F.col(spec.key), F.lit("")))
    for parent_type, fk in spec.parents.items():
        staged = lookup(
            staged, id_maps[parent_type], F.nullif(F.col(fk), F.lit("")), "source_id",
            {f"to_{parent_type}": "target_id"}, spec.columns,
            (rows, F.nullif(F.col(fk), F.lit(""))),
        )
    staged = spec.mapper(staged)

    reject = F.when(F.col("source_id").isNull(), message(C.MISSING_KEY, field=spec.key))
    no_warning = F.array().cast("array<string>")
    early = no_warning
    if spec.must_exist:
        fk = spec.parents[spec.must_exist]
        orphan = F.col(f"to_{spec.must_exist}").isNull()
        text = message(C.ORPHAN, F.col(fk), field=fk)
        if import_orphans:
            early = F.when(orphan, F.array(F.concat(text, F.lit(C.ORPHAN_KEPT)))).otherwise(no_warning)
        else:
            reject = F.coalesce(reject, F.when(orphan, text))
    # a row rejected before its mapping has no warnings; one rejected by it keeps the early ones
    staged = (
        staged.withColumn("_early", reject)
        .withColumn("reason", F.coalesce("_early", "error"))
        .withColumn(
            "warnings",
            F.when(F.col("_early").isNotNull(), no_warning).otherwise(F.concat(early, F.col("warnings"))),
        )
        .drop("_early", "error")
    )
    accepted = F.col("reason").isNull()
    external = F.when(accepted, external_id(C.CSV_SOURCE, spec.object_type, F.col("source_id")))
    if dry_run:
        return staged.withColumn(
            "status", F.when(accepted, F.lit("planned")).otherwise(F.lit(C.REJECTED))
        ).withColumn("target_id", F.concat(F.lit(C.DRY_RUN_PREFIX), external))

    if target is None:
        staged = staged.withColumn("existing_id", F.lit(None).cast("string"))
    else:
        counted = external_id(C.CSV_SOURCE, spec.object_type, F.nullif(F.col(spec.key), F.lit("")))
        staged = match_external(staged, target, external, spec.columns, (rows, counted))
    refused = first_broken(list(constraints))
    staged = staged.withColumn("_refused", F.when(accepted, refused))
    return (
        staged.withColumn(
            "status",
            F.when(~accepted, F.lit(C.REJECTED))
            .when(F.col("_refused").isNotNull(), F.lit(C.FAILED))
            .when(F.col("existing_id").isNotNull(), F.lit(C.UPDATED))
            .otherwise(F.lit(C.CREATED)),
        )
        # an existing record stays a valid parent even where its update was refused
        .withColumn(
            "target_id",
            F.coalesce(
                F.when(accepted, F.col("existing_id")),
                F.when(accepted & F.col("_refused").isNull(), new_id(external)),
            ),
        )
        .withColumn("reason", F.coalesce("reason", "_refused"))
        .drop("_refused", "existing_id")
    )


def id_map(staged: DataFrame) -> DataFrame:
    """``(source_id, target_id)`` of the rows that survived, one row per source id."""
    return (
        staged.where(F.col("target_id").isNotNull())
        .groupBy("source_id")
        .agg(F.max("target_id").alias("target_id"))
    )


@dataclass
class Migration:
    staged: dict[str, DataFrame]
    specs: dict[str, CsvSpec]
    dry_run: bool
    run_id: str

    def problems(self, status: str) -> DataFrame:
        """Rows of one status with their reason and their original columns."""
        parts = [
            frame.where(F.col("status") == status).select(
                F.lit(t).alias("object_type"), F.col("reason").alias("failure_reason"),
                *self.specs[t].columns, F.lit(self.run_id).alias("run_id"),
            )
            for t, frame in self.staged.items()
        ]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def rejections(self) -> DataFrame:
        return self.problems(C.REJECTED)

    def failures(self) -> DataFrame:
        return self.problems(C.FAILED)

    def warnings(self) -> DataFrame:
        parts = [
            frame.where(F.size("warnings") > 0).select(
                F.lit(t).alias("object_type"), "source_id", F.explode("warnings").alias("message"),
                F.lit(self.run_id).alias("run_id"))
            for t, frame in self.staged.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    def references(self) -> DataFrame:
        parts = [
            E.pairs(self.staged[t], t, parent, self.specs[t].key, fk, f"to_{parent}")
            for t in self.staged for parent, fk in self.specs[t].parents.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    def edges(self) -> DataFrame:
        return self.references().where(F.col("reason").isNull())

    def missing_associations(self) -> DataFrame:
        return self.references().where(F.col("reason").isNotNull()).select(
            "label", "from_key", "to_key", "reason", F.lit(self.run_id).alias("run_id"))

    def changes(self, object_type: str, ordinal: str) -> DataFrame:
        """Property changes per target record; of rows with one source id the last in ``ordinal`` counts.

        ``ordinal`` names a column of the source that gives its order, such as the one ``read_csv`` adds.
        """
        frame = self.staged[object_type].where(F.col("status").isin(C.CREATED, C.UPDATED))
        return M.fold_changes(frame, object_type, (ordinal, "source_id"))

    def merged(self, object_type: str, target: DataFrame, ordinal: str) -> DataFrame:
        return M.merge(target, self.changes(object_type, ordinal), object_type)


def migrate(
    sources: dict[str, DataFrame],
    targets: dict[str, DataFrame] | None = None,
    import_orphans: bool = True,
    dry_run: bool = False,
    constraints: Constraints | None = None,
    run_id: str = "run",
    pinned: bool = True,
) -> Migration:
    """Stages the entities of ``sources`` (object type -> rows).

    ``pinned`` writes each staged frame once to the shared folder, as later entities and
    every report read it; without it they run its plan again.
    """
    staged: dict[str, DataFrame] = {}
    maps: dict[str, DataFrame] = {}
    specs = {s.object_type: s for s in CSV_SPECS if s.object_type in sources}
    for object_type, spec in specs.items():
        frame = stage(
            sources[object_type], spec, maps, (targets or {}).get(object_type),
            import_orphans, dry_run, (constraints or {}).get(object_type, []),
        )
        staged[object_type] = pin(frame) if pinned else frame
        maps[object_type] = id_map(staged[object_type])
    return Migration(staged, specs, dry_run, run_id)

"""Change sync: a batch of changes, applied from the current state of the records.

One pass per entity, children first to collect the parents they need, then
parents first to write. All steps are joins and aggregates; the same function
serves a batch job, a rescan and every micro-batch of a stream.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill import contract as C
from recordmill.functions import first_link, message
from recordmill.operators import edges as E
from recordmill.operators import merge as M
from recordmill.operators.batches import numbered_batches
from recordmill.operators.identity import find_parents, resolve
from recordmill.operators.lookup import few, lookup, relevant
from recordmill.operators.mapping import RECORD_SPECS, RecordSpec, record_external_id
from recordmill.operators.validate import first_broken, is_blank
from recordmill.plans.pins import pin
from recordmill.sources.records import changed_after, modified_since

#: No retry changes these.
PERMANENT_CODES = (C.VALIDATION_ERROR, C.MISSING_REFERENCE)
SPECS = {s.entity: s for s in RECORD_SPECS}
class Targets(Protocol):
    """A target of which only the part that some rows may match is read."""

    def near(self, object_type: str, rows: DataFrame) -> DataFrame:
        """The records that ``rows (known_id, external_id, natural_key)`` may match."""

    def taken(self, object_type: str, ids: DataFrame) -> DataFrame:
        """Those of the ids (column ``id``) that exist."""


class Records(Protocol):
    """A record table of which only the rows that some keys name are read."""

    table: DataFrame

    def pick(self, column: str, keys: DataFrame) -> DataFrame:
        """The rows whose ``column`` is one of ``keys``."""


def table_of(source: "DataFrame | Records") -> DataFrame:
    return source if isinstance(source, DataFrame) else source.table


def pick(source: "DataFrame | Records", column: str, keys: DataFrame, exact: bool = True) -> DataFrame:
    """The rows that some key names; without ``exact`` a table that many keys name comes whole, as it is."""
    return relevant(source, column, keys, exact) if isinstance(source, DataFrame) else source.pick(column, keys)


def records(source: DataFrame, spec: RecordSpec) -> DataFrame:
    """The columns a sync needs; link columns and the stored id are optional in the source."""
    have = dict(source.dtypes)
    links = [F.col(f"`{c}`") for c in spec.links if c in have]
    known = F.col(C.KNOWN_ID) if C.KNOWN_ID in have else F.lit(None).cast("string")
    return source.select("record_id", known.alias(C.KNOWN_ID), *[
        (F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in spec.fields
    ], *links)


def link_of(df: DataFrame, spec: RecordSpec) -> Column:
    kinds = dict(df.dtypes)
    choices = [
        (F.col(f"`{c}`"), "array" if kinds[c].startswith("array") else "string")
        for c in spec.links if c in kinds
    ]
    return first_link(*choices) if choices else F.lit(None).cast("string")


def payload_records(changes: DataFrame, spec: RecordSpec, like: DataFrame) -> DataFrame:
    """Records as the payload gives them, with the columns of ``like``; a bare link becomes a list."""
    names = [C.KNOWN_ID, *spec.fields, *[c for c in like.columns if c in spec.links]]
    raw = changes.select(
        "record_id", "seq", F.json_tuple("fields", *names).alias(*[f"_{i}" for i in range(len(names))])
    )
    kinds = {f.name: f.dataType for f in like.schema.fields}
    out = []
    for i, name in enumerate(names):
        text = F.col(f"_{i}")
        if isinstance(kinds[name], T.ArrayType):
            text = F.when(text.startswith("["), F.from_json(text, "array<string>")).when(
                text.startswith("rec"), F.array(text))
        out.append(text.alias(name))
    return raw.select("record_id", "seq", *out)


def work_rows(changes: DataFrame, source: DataFrame, spec: RecordSpec, keep: Callable[[DataFrame], DataFrame] = pin) -> DataFrame:
    """What each change stands for: the record as it is now, or its payload where it is gone.

    One row per record that can be read, whatever the number of its changes; one
    row per change that has to be taken from its payload; changes with neither
    are ``record_not_found``. Records are kept as they were read, with a ``work_id``; what the mapper adds is computed
    where it is read.
    """
    mine = changes.where(F.col("entity") == spec.entity)
    now = records(table_of(source), spec)  # for its columns
    asked = mine.groupBy("record_id").agg(F.min("seq").alias("seq"))
    near = records(pick(source, "record_id", asked.select("record_id"), exact=False), spec).withColumn("in_source", F.lit(True))
    # one join tells the records that are there and those that are gone
    found = keep(asked.join(near, "record_id", "left").withColumn("work_id", F.monotonically_increasing_id()))
    rows = _unless_blank(found.where("in_source").withColumn("work_key", F.col("record_id")))
    lost = found.where(F.col("in_source").isNull()).select("record_id")
    if not lost.isEmpty():
        rows = rows.unionByName(keep(_gone(mine, lost, spec, now)))
    return spec.mapper(rows).withColumn("asked", F.lit(True))


def _unless_blank(rows: DataFrame) -> DataFrame:
    return rows.withColumn("skip", F.when(is_blank(rows, ("seq", "work_key", "work_id", "in_source")), F.lit(C.BLANK_RECORD)))


def _gone(mine: DataFrame, lost: DataFrame, spec: RecordSpec, like: DataFrame) -> DataFrame:
    """Work rows of the changes whose records are ``lost`` (each once) or not named: from their payload, or not found."""
    if few(lost):
        gone = mine.join(F.broadcast(lost), "record_id", "left_semi")
    else:  # a record with very many changes is split among tasks
        gone = lookup(mine, lost.select(F.col("record_id").alias("_id")), F.col("record_id"), "_id", {"_lost": "_id"},
                      ["seq"]).where(F.col("_lost").isNotNull()).drop("_lost")
    gone = gone.unionByName(mine.where(F.col("record_id").isNull()))
    work_key = F.concat_ws("#", "record_id", F.lpad(F.col("seq").cast("string"), 20, "0"))
    payload = _unless_blank(payload_records(gone.where(F.col("fields").isNotNull()), spec, like).withColumns(
        {"work_key": work_key, "in_source": F.lit(False)}))
    missing = gone.where(F.col("fields").isNull()).select(
        "record_id", "seq", work_key.alias("work_key"), F.lit(C.RECORD_NOT_FOUND).alias("skip"))
    return payload.unionByName(missing, allowMissingColumns=True).withColumn("work_id", -1 - F.monotonically_increasing_id())


def _pulled(children: list[DataFrame], work: DataFrame, source: DataFrame, spec: RecordSpec,
            keep: Callable[[DataFrame], DataFrame] = pin) -> DataFrame:
    """``work`` plus the unsynced parents its children need and no change names."""
    needed = reduce(DataFrame.unionByName, [
        c.where(F.col("needs_parent")).select(F.col("parent_record").alias("record_id")) for c in children
    ]).distinct()
    extra = keep(needed.join(work.where("in_source").select("record_id"), "record_id", "left_anti"))
    if extra.isEmpty():
        return work
    rows = keep(records(pick(source, "record_id", extra), spec).withColumns({
        "seq": F.lit(-1).cast("bigint"), "work_key": F.col("record_id"), "in_source": F.lit(True),
        "skip": F.lit(None).cast("string"), "work_id": F.monotonically_increasing_id() + F.lit(1 << 62),
    }))
    return work.unionByName(spec.mapper(rows).withColumn("asked", F.lit(False)), allowMissingColumns=True)


def _with_parents(work: DataFrame, parents: DataFrame, spec: RecordSpec) -> DataFrame:
    """Adds ``parent_record``, ``parent_known_id`` and ``needs_parent`` to the rows that will be written."""
    parent_spec = SPECS[spec.parent]
    live = F.col("skip").isNull() & F.col("error").isNull()
    link = F.when(live, link_of(work, spec))
    key = F.when(live, F.col(spec.business_key))
    keyed = spec.business_key in table_of(parents).columns and spec.business_key in parent_spec.fields
    # only parents that some child names, by either way, are worth a shuffle; where many are named, it moves all of them
    linked = pick(parents, "record_id", work.select(link.alias("k")), exact=False)
    named = pick(parents, spec.business_key, work.select(key.alias("k")), exact=False) if keyed and linked is not parents else linked
    if named is linked or named is parents:
        candidates = records(named, parent_spec)
    else:
        candidates = records(linked, parent_spec).unionByName(records(named, parent_spec))
    if keyed:
        candidates = candidates.dropDuplicates(["record_id"])
    found = find_parents(work, candidates, link, key if keyed else None, spec.business_key)
    return found.withColumn(
        "needs_parent", F.col("parent_record").isNotNull() & F.col("parent_known_id").isNull()
    )


@dataclass
class SyncResult:
    #: seq, entity, record_id, status, reason, code, target_id, action, matched_by, parent_id, parent_missing,
    #: parent_note, permanent, run_id; of events also event_no and attempts, and seq is the event's own id
    outcomes: DataFrame
    written: dict[str, DataFrame]  # per object type: resolved rows that are written
    changes: dict[str, DataFrame]  # per object type: folded properties per target record
    targets: dict[str, DataFrame]  # per object type: the target records looked at
    edges: DataFrame
    events: DataFrame | None = None  # event_no, seq, entity, record_id, fields, attempts, error, error_code

    def merged(self, object_type: str, how: str = "full") -> DataFrame:
        """The target after the sync; ``how="right"`` gives the touched records only. Types of this run only."""
        return M.merge(self.targets[object_type], self.changes[object_type], object_type, how)

    def write_backs(self, object_type: str) -> DataFrame:
        """``(record_id, target_id)`` to store in the source."""
        return M.write_backs(self.written[object_type].where("in_source"))


def sync(
    changes: DataFrame,
    sources: "dict[str, DataFrame | Records]",
    targets: dict[str, DataFrame] | Targets,
    batch: str = "0",
    constraints: dict[str, list[tuple[Column, str]]] | None = None,
    keep: Callable[[DataFrame], DataFrame] = pin,
) -> SyncResult:
    """Applies ``changes (seq, entity, record_id, fields)``; ``seq`` is unique, not null and gives their order.

    ``sources`` holds the record table of each entity, ``targets`` the snapshot
    of each object type; either may be an object that gives only the part that matters
    for some rows. ``keep`` is applied to the results that several steps read,
    so that no step is planned, or run, more than once.
    """
    partial = not isinstance(targets, dict)
    changes = keep(changes)
    active = _active(changes)
    work = {e: work_rows(changes, sources[e], SPECS[e], keep) for e in active}
    linked: dict[str, DataFrame] = {}

    # children first: which unsynced parents do they pull in?
    for entity in reversed(active):
        spec = SPECS[entity]
        children = [linked[s.entity] for s in RECORD_SPECS if s.parent == entity and s.entity in active]
        if children:
            work[entity] = _pulled(children, work[entity], sources[entity], spec, keep)
        linked[entity] = _narrow(work[entity], spec)
        if spec.parent:
            linked[entity] = keep(_with_parents(linked[entity], sources[spec.parent], spec).drop("work_key", *spec.links))

    # parents first: write
    written: dict[str, DataFrame] = {}
    changed: dict[str, DataFrame] = {}
    seen: dict[str, DataFrame] = {}
    ended: dict[str, DataFrame] = {}  # per entity: record_id, target_id or the reason why there is none
    outcomes, edges = [], []
    for entity in active:
        spec, object_type = SPECS[entity], C.OBJECT_TYPE_OF[entity]
        rows = linked[entity]
        if spec.parent:
            need = F.when(F.col("needs_parent"), F.col("parent_record"))
            rows = lookup(rows, ended[spec.parent], need, "record_id", {"_new_parent": "target_id", "_parent_reason": "reason"},
                          ["work_id"], (rows, need), apart=True)
            rows = rows.withColumn("parent_id", F.coalesce("parent_known_id", "_new_parent")).drop("_new_parent")
            no_parent = message(C.NO_PARENT, F.col(spec.business_key), table=C.TABLE_OF[spec.parent],
                                links=", ".join(spec.links), key=spec.business_key)
            before, after = C.PARENT_FAILED.split("{parent}")
            parent_failed = F.concat(F.lit(before), "parent_record", message(after, F.col("_parent_reason")))
            rows = rows.withColumn("parent_note", F.when(
                F.col("skip").isNull() & F.col("error").isNull() & F.col("parent_id").isNull(),
                F.when(F.col("parent_record").isNull(), no_parent).otherwise(parent_failed))).drop("_parent_reason")
        else:
            rows = rows.withColumns({"parent_id": F.lit(None).cast("string"), "parent_note": F.lit(None).cast("string")})
        live = F.col("skip").isNull() & F.col("error").isNull()
        orphan = live & F.lit(spec.required) & F.col("parent_id").isNull()
        broken = (constraints or {}).get(object_type, [])
        kept = rows.columns
        if broken:  # they may read any column
            rows = _whole(rows, work[entity])
        refused = F.when(live & ~orphan, first_broken(broken))
        rows = rows.withColumn("code", F.when(F.col("skip").isNotNull(), F.lit(None))
                               .when(F.col("error").isNotNull(), F.lit(C.VALIDATION_ERROR))
                               .when(orphan, F.lit(C.MISSING_REFERENCE))
                               .when(refused.isNotNull(), F.lit(C.TARGET_REFUSED)))
        rows = rows.withColumn("reason", F.coalesce("skip", "error", F.when(orphan, F.col("parent_note")), refused))
        rows = keep(rows.select(*kept, "code", "reason"))
        good = rows.where(F.col("reason").isNull())
        natural = C.NATURAL_KEY[object_type]
        # several payloads of one record are one record
        identities = good.groupBy("record_id").agg(
            F.min("seq").alias("seq"), F.max_by("known_id", "seq").alias("known_id"),
            (F.max_by("natural_key", F.when(F.col("natural_key").isNotNull(), F.col("seq")))
             if natural else F.lit(None).cast("string")).alias("natural_key"),
        ).withColumns({"known_id": F.nullif("known_id", F.lit("")), "external_id": record_external_id(object_type)})
        identities = keep(identities)
        taken = None
        if partial:  # a part of a log, which the steps below would each filter again
            target = keep(targets.near(object_type, identities))
            taken = partial_taken(targets, object_type)
        else:
            target = targets[object_type]
        resolved = keep(resolve(identities, target, natural, batch, taken).select(
            "record_id", "known_id", "target_id", "action", "matched_by"))
        # only payloads can be many of one record
        mine = lookup(good.drop("known_id", "natural_key"), resolved.withColumnRenamed("record_id", "_id"),
                      F.col("record_id"), "_id", {c: c for c in ("known_id", "target_id", "action", "matched_by")}, ["work_id"],
                      (good.where(~F.coalesce("in_source", F.lit(False))), F.col("record_id")))
        written[object_type] = _whole(mine, work[entity])
        seen[object_type] = target
        changed[object_type] = M.fold_changes(written[object_type], object_type)
        ids = resolved.select("record_id", "target_id")
        failed = rows.where(F.col("reason").isNotNull() & F.coalesce("in_source", F.lit(False))).select("record_id", "reason")
        ended[entity] = ids.unionByName(failed.join(ids, "record_id", "left_anti"), allowMissingColumns=True)
        if spec.parent:
            edges.append(mine.where(F.col("parent_id").isNotNull()).select(*E.edge(
                object_type, F.col("target_id"), C.OBJECT_TYPE_OF[spec.parent], F.col("parent_id"))))
        outcomes.append(_outcomes(changes, rows, resolved, spec))
    no_edge = changes.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in E.EDGE))
    return SyncResult(
        reduce(DataFrame.unionByName, [*outcomes, _unknown(changes)]).withColumns({
            "permanent": _permanent(F.col("code")), "run_id": F.lit(batch)}), written, changed, seen,
        reduce(DataFrame.unionByName, edges).distinct() if edges else no_edge,
    )


def _narrow(rows: DataFrame, spec: RecordSpec) -> DataFrame:
    """What decides about a work row, without its data: that is joined back by ``work_id`` where it is read."""
    natural = C.NATURAL_KEY[spec.object_type]
    parent = []
    if spec.parent:  # the names of link columns hold blanks
        parent = [F.col("work_id").alias("work_key"), spec.business_key, *[F.col(f"`{c}`") for c in spec.links if c in rows.columns]]
    return rows.select(
        "work_id", "record_id", "seq", "in_source", "asked", "skip", "error", F.col(C.KNOWN_ID).alias("known_id"),
        (F.col(f"props.{natural}") if natural else F.lit(None).cast("string")).alias("natural_key"), *parent)


def _whole(rows: DataFrame, work: DataFrame) -> DataFrame:
    """``rows`` with all columns of their work rows."""
    return rows.join(work.select("work_id", *[c for c in work.columns if c not in rows.columns]), "work_id")


def partial_taken(targets: Targets, object_type: str) -> Callable[[DataFrame], DataFrame]:
    return lambda ids: targets.taken(object_type, ids)


def _permanent(code: Column) -> Column:
    return F.coalesce(code.isin(*PERMANENT_CODES), F.lit(False))


def _unknown(changes: DataFrame) -> DataFrame:
    """Failed outcomes of the changes that name none of the four tables."""
    text = lambda: F.lit(None).cast("string")
    return changes.where(~F.coalesce(F.col("entity").isin(*C.ENTITIES), F.lit(False))).select(
        *_named(changes), F.lit(C.FAILED).alias("status"),
        message(C.UNKNOWN_TABLE, F.col("entity")).alias("reason"), F.lit(C.VALIDATION_ERROR).alias("code"),
        text().alias("target_id"), text().alias("action"), text().alias("matched_by"), text().alias("parent_id"),
        F.lit(False).alias("parent_missing"), text().alias("parent_note"))


def _named(changes: DataFrame) -> list[str]:
    """What tells a change: number, entity and record, and what its event says of itself."""
    return [c for c in ("seq", "entity", "record_id", "event_id", "attempts") if c in changes.columns]


def _active(changes: DataFrame) -> list[str]:
    """Entities with changes and the parents those may pull in, parents first; companies at least."""
    known = changes.where(F.col("entity").isin(*C.ENTITIES))
    present = {r.entity for r in known.select("entity").distinct().collect()}  # four values at most
    active = {C.COMPANY}
    for entity in present:
        while entity:
            active.add(entity)
            entity = SPECS[entity].parent
    return [e for e in C.ENTITIES if e in active]


def _outcomes(changes: DataFrame, rows: DataFrame, resolved: DataFrame, spec: RecordSpec) -> DataFrame:
    """One row per change: what became of it."""
    done = rows.where("asked").join(resolved.drop("known_id"), "record_id", "left")
    spread = done.select(
        "record_id", F.when(~F.coalesce("in_source", F.lit(False)), F.col("seq")).alias("_own"),
        F.when(F.col("skip").isNotNull(), F.lit(C.SKIPPED)).when(F.col("reason").isNotNull(), F.lit(C.FAILED))
        .otherwise(F.lit(C.SYNCED)).alias("status"),
        "reason", "code",
        *[F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("target_id", "action", "matched_by", "parent_id")],
        (F.col("reason").isNull() & F.lit(spec.parent is not None) & F.col("parent_id").isNull()).alias("parent_missing"),
        "parent_note",
    )
    mine = changes.where(F.col("entity") == spec.entity).select(*_named(changes))
    # without payloads there is nothing to find by the changes' own numbers
    payloads = rows.where(F.col("asked") & ~F.coalesce("in_source", F.lit(False))).select("seq")
    own = spread.where(F.col("_own").isNotNull()).drop("record_id")
    own = None if payloads.isEmpty() else F.broadcast(own) if few(payloads) else own
    shared = lookup(mine, spread.where(F.col("_own").isNull()).withColumnRenamed("record_id", "_rid"),
                    F.col("record_id"), "_rid",
                    {c: c for c in spread.columns if c not in ("record_id", "_own")}, ["seq"])
    shared = shared.where(F.col("status").isNotNull())
    return shared if own is None else shared.unionByName(mine.join(own, F.col("seq") == F.col("_own")).drop("_own"))


def numbered_events(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Events, one for each id, with ``event_no`` from 1: in the order of their ids, those without an id first.

    Ids are of any type and may be missing. Events are delivered at least once: those that share an id are one event, and
    should their contents differ, the smallest counts. Events without an id stay apart. ``attempts``, where
    given, says how often an event was tried before.
    """
    columns = ["entity", "record_id", "fields", "error", "error_code"]
    tried = F.coalesce("attempts", F.lit(0)) if "attempts" in events.columns else F.lit(0)
    events = events.select(F.col(seq).alias("event_id"), *columns, tried.cast("int").alias("attempts"))
    once = events.where(F.col("event_id").isNotNull()).groupBy("event_id").agg(
        F.min(F.struct(*columns)).alias("_event"), F.max("attempts").alias("attempts")
    ).select("event_id", "_event.*", "attempts")
    every = once.unionByName(events.where(F.col("event_id").isNull()))
    order = F.struct("event_id", *columns, F.monotonically_increasing_id().alias("row"))
    return numbered_batches(every.withColumn("_order", order), "_order").withColumnRenamed("ordinal", "event_no").drop(
        "_order", "batch_no")


def sync_events(events: DataFrame, sources: dict, targets, seq: str = "seq", **options) -> SyncResult:
    """Sync of normalised events (see ``numbered_events``); unreadable ones become failed outcomes without an entity.

    Each event has one outcome: ``seq`` is its id as given (null where it has none), ``event_no`` its number here.
    """
    # parsed once: a filter on the parse error must not parse a second time
    events = options.get("keep", pin)(numbered_events(events, seq))
    good = events.where(F.col("error").isNull()).select(
        F.col("event_no").cast("bigint").alias("seq"), "event_id", "entity", "record_id", "fields", "attempts")
    result = sync(good, sources, targets, **options)
    text = lambda: F.lit(None).cast("string")
    bad = events.where(F.col("error").isNotNull()).select(
        F.col("event_no").cast("bigint").alias("seq"), "entity", "record_id", "event_id", "attempts",
        F.lit(C.FAILED).alias("status"),
        F.col("error").alias("reason"), F.col("error_code").alias("code"), text().alias("target_id"),
        text().alias("action"), text().alias("matched_by"), text().alias("parent_id"),
        F.lit(False).alias("parent_missing"), text().alias("parent_note"),
        _permanent(F.col("error_code")).alias("permanent"), F.lit(options.get("batch", "0")).alias("run_id"),
    )
    result.outcomes = result.outcomes.unionByName(bad).withColumnsRenamed({"seq": "event_no", "event_id": "seq"}).withColumn(
        "attempts", F.col("attempts") + 1)
    result.events = events.withColumnRenamed("event_id", "seq")
    return result


def rescan_changes(sources: dict[str, DataFrame], since: str, limit: int | None = None) -> DataFrame:
    """Changes found by looking back: per table, parents first, every record modified after ``since``."""
    parts = []
    for order, entity in enumerate(C.ENTITIES):
        table = table_of(sources[entity])
        # all of them need no order: their numbers give it
        found = changed_after(table, since) if limit is None else modified_since(table, since, limit)
        parts.append(found.select(
            # parents first, then by time; the record id decides among equals in later folds
            (F.lit(order).cast("bigint") * F.lit(1 << 60) + F.unix_micros(F.col(C.MODIFIED).cast("timestamp"))).alias("seq"),
            F.lit(entity).alias("entity"), "record_id", F.lit(None).cast("string").alias("fields")))
    return reduce(DataFrame.unionByName, parts)


def rescan(sources: dict, targets, since: str, limit: int | None = None, waiting: DataFrame | None = None,
           **options) -> SyncResult:
    """Sync of what was modified after ``since``, and of the records that ``waiting (entity, record_id, fields)`` names."""
    changes = rescan_changes(sources, since, limit)
    if waiting is not None:
        changes = options.get("keep", pin)(changes)
        rest = waiting.select("entity", "record_id", "fields").dropDuplicates(["entity", "record_id"]).join(
            changes.select("entity", "record_id"), ["entity", "record_id"], "left_anti")
        changes = changes.unionByName(rest.withColumn("seq", -2 - F.monotonically_increasing_id()))
    return sync(changes, sources, targets, **options)

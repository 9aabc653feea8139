"""The stream's log: which files a batch opens, what it remembers of events, and what it tries again."""

import json

import pytest
from pyspark.sql import functions as F

from recordmill import contract as C
from recordmill.functions import event_fields
from recordmill.operators import merge as M
from recordmill.operators import report as P
from recordmill.operators.identity import new_id, resolve
from recordmill.plans.sync import rescan, sync_events
from recordmill.streaming import SyncLog, event_stream
from tests.test_sync import IDENTITY, no_targets, tables

SCHEMA = "event_id string, body string"


def company(k, **more):
    row = {"record_id": f"rec{k}", "known": None, "company_id": f"C-{k}", "name": f"Name {k}", "domain": f"d{k}.example",
           "industry": None, "employees": None} | more
    return tuple(row.values())


def body(record, **more):
    return json.dumps({"table": "Companies", "recordId": record} | more)


def apply(log, events, sources, batch, **options):
    """One micro-batch, without the stream around it."""
    rows = event_fields(log.spark.createDataFrame(events, SCHEMA))
    live, target = log.state(sources, batch)
    result = sync_events(log.unseen(rows, "event_id", batch), live, target, seq="event_id", batch=str(batch), **options)
    log.append(batch, result, C.MOST_ATTEMPTS)


@pytest.fixture(scope="module")
def started(spark, tmp_path_factory):
    """A log of 300 companies and five batches, and the same changes as one batch plan."""
    targets = no_targets(spark, companies=[(f"T{k}", f"Old {k}", f"d{k}.example" if k % 2 else None, None, None,
                                            None if k % 2 else f"airtable:companies:rec{k}", None) for k in range(300)])
    sources = tables(spark, company=[company(k) for k in range(0, 600, 3)])
    log = SyncLog(spark, str(tmp_path_factory.mktemp("log")), buckets=16).start_from(targets)
    batches = [[(f"e{b}-{k}", body(f"rec{k}")) for k in (3 * b, 3 * b + 300, 3)] for b in range(4)]
    for number, events in enumerate(batches):
        apply(log, events, sources, number)
    whole = sync_events(event_fields(spark.createDataFrame([e for b in batches for e in b], SCHEMA)), sources, targets, seq="event_id")
    return log, sources, whole


def keys(spark, **one):
    return spark.createDataFrame([tuple(one.get(c) for c in ("known_id", "external_id", "natural_key"))],
                                 "known_id string, external_id string, natural_key string")


def test_batches_end_where_the_batch_plan_does(started):
    log, _, whole = started
    assert sorted(log.target(C.COMPANIES).collect()) == sorted(whole.merged(C.COMPANIES).drop("action").collect())
    assert log.outcomes().count() == whole.outcomes.count()


def test_a_batch_opens_the_files_of_its_keys_only(spark, started):
    log, *_ = started
    name = f"targets/{C.COMPANIES}"
    every = len(log.read(name).inputFiles())
    one = spark.createDataFrame([("T7",)], "id string")
    few = len(log.read(name, None, one).inputFiles())
    assert every > 16 and few <= 5
    by_key = {"known_id": "T4", "external_id": "airtable:companies:rec6", "natural_key": "d7.example"}
    for column, value in by_key.items():
        found = log.near(C.COMPANIES, keys(spark, **{column: value})).collect()
        assert [r.id for r in found] == [{"known_id": "T4", "external_id": "T6", "natural_key": "T7"}[column]]
    assert [r.id for r in log.taken(C.COMPANIES, spark.createDataFrame([("T1",), ("none",), (None,)], "id string")).collect()] == ["T1"]

    state = sorted(log.target(C.COMPANIES).collect())
    log.compact(3)  # batch 3 stays beside it
    assert log.compacted() == 2 and log.compacted(2) is None
    assert len(log.read(name).inputFiles()) < every and len(log.read(name, None, one).inputFiles()) <= 2
    assert sorted(log.target(C.COMPANIES).collect()) == state
    # the state before batch 2, should that run again, is still there
    assert log.target(C.COMPANIES, 2).count() < len(state)
    log.compact(4)
    log.compact(4)
    assert log.compacted() == 3 and sorted(log.target(C.COMPANIES).collect()) == state
    assert not log._names(f"{name}/batch_id=0") and log._names(f"{name}/batch_id=3")


def test_bucket_counts_must_agree(started):
    with pytest.raises(ValueError):
        SyncLog(started[0].spark, started[0].folder, buckets=4).state({}, 1)


def test_traces_open_the_folders_they_need(started):
    log, *_ = started
    rows = log.trace(record_id="rec3")
    assert sorted(r.seq for r in rows.collect()) == ["e0-3", "e1-3", "e2-3", "e3-3"]
    assert {r.seq for r in log.trace(run=1).collect()} == {"e1-3", "e1-303"}
    assert {r.record_id for r in log.trace(entity=C.COMPANY, action=C.CREATED).collect()} == {"rec300", "rec303", "rec306", "rec309"}
    plan = rows.where("batch_id = 1")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "bucket" in filters and "batch_id" in filters


def test_figures_are_observed_while_outcomes_are_written(started):
    log, *_ = started
    for row in log.summaries().collect():
        tally = P.rescan_tally(log.trace(run=row.batch_id)).first()
        assert row.asDict() == tally.asDict() | {"batch_id": row.batch_id} and row.scanned


@pytest.mark.parametrize("together", [True, False])
def test_events_come_again_in_one_batch_or_later(spark, tmp_path, together):
    """Null ids stay apart, others count once; no record without an id comes of it."""
    sources = tables(spark, company=[company(1)])
    gone = body("recGone", fields={"company_name": "Gone Ltd"})
    events = [(None, gone), (None, gone), (None, body("rec1")), ("7", gone), ("seven", body("rec1")), (None, "no json")]
    log = SyncLog(spark, str(tmp_path / "log"), buckets=2).start_from(no_targets(spark))
    for number, rows in enumerate([events + events] if together else [events, events]):
        apply(log, rows, sources, number)
    got = sorted((r.seq or "", r.record_id or "", r.status) for r in log.outcomes().collect())
    assert got == sorted([("", "recGone", "synced")] * 4 + [("", "rec1", "synced"), ("", "", "failed")] * 2
                         + [("7", "recGone", "synced"), ("seven", "rec1", "synced")])
    records = log.target(C.COMPANIES).collect()
    assert len(records) == 2 and all(r.id for r in records)
    assert log.outcomes().where("status = 'synced' and target_id is null").isEmpty()


def test_failures_are_tried_again_without_an_event(spark, tmp_path):
    sources = tables(spark, company=[company(1), company(2), company(3, name="")])
    log = SyncLog(spark, str(tmp_path / "log"), buckets=2).start_from(no_targets(spark))
    for part, chunk in enumerate(([("a", body("rec1")), ("b", body("rec3"))], [("c", body("rec2"))], [("d", "no json")])):
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/p={part}"))
    refused = {C.COMPANIES: [(F.col("props.name") == "Name 1", "closed")]}

    def run(parts, constraints, most=5):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in/p={parts}"))
        job = event_stream(stream, lambda: sources, log, str(tmp_path / f"c{len(done)}"), most_attempts=most, constraints=constraints)
        done.append(job.trigger(availableNow=True).start())
        done[-1].awaitTermination(600)
        assert done[-1].exception() is None

    done = []
    run("[01]", refused)
    tries = [(r.batch_id, r.record_id, r.status, r.attempts) for r in log.outcomes().orderBy("batch_id", "record_id").collect()]
    assert tries == [(0, "rec1", "failed", 1), (0, "rec3", "failed", 1), (1, "rec1", "failed", 2), (1, "rec2", "synced", 1)]
    assert [(r.seq, r.attempts) for r in log.backlog(2).collect()] == [("a", 2)]
    # the next batch names other records; nothing refuses the first one now
    live, target = log.state(sources, 2)
    log.append(2, rescan(sources, target, "2030-01-01 00:00:00", None, log.backlog(2), batch="2"), 5)
    last = [(r.record_id, r.status) for r in log.trace(run=2).collect()]
    assert last == [("rec1", "synced")] and log.backlog(3).isEmpty()
    assert log.target(C.COMPANIES).count() == 2


def test_ids_are_derived_until_one_is_free(spark):
    taken = [new_id(F.lit("e1")), new_id(F.lit("e1"), "@7"), new_id(F.lit("e1"), "@7#2"), new_id(F.lit("e2"))]
    target = spark.range(1).select(F.explode(F.array(*taken)).alias("id")).select(
        "id", F.lit(None).cast("string").alias("domain"), F.concat(F.lit("other"), "id").alias("external_source_id"))
    rows = spark.createDataFrame([(f"r{k}", k, None, f"e{k}", None) for k in range(4)], IDENTITY)
    got = {r.record_id: r for r in resolve(rows, target, "domain", "7").collect()}
    want = spark.range(1).select(new_id(F.lit("e0")), new_id(F.lit("e1"), "@7#3"), new_id(F.lit("e2"), "@7"), new_id(F.lit("e3"))).first()
    assert [got[f"r{k}"].target_id for k in range(4)] == list(want)
    assert {r.action for r in got.values()} == {"created"}


def test_a_row_without_a_target_changes_nothing(spark):
    rows = spark.createDataFrame([(None, 1, "r", "x")], "target_id string, seq long, record_id string, v string").select(
        "*", F.struct(*[F.lit("v").alias(c) for c in M.target_columns(C.COMPANIES)[1:]]).alias("props"))
    assert M.fold_changes(rows, C.COMPANIES).isEmpty()

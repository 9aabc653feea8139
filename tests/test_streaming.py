"""The event stream ends where the batch does, however often events come."""

import base64
import hashlib
import hmac
import json
import os

from recordmill import contract as C
from recordmill.functions import event_fields
from recordmill.plans.pins import shared_folder
from recordmill.plans.sync import sync_events
from recordmill.streaming import SyncLog, doorbell_stream, event_stream
from tests.test_sync import FENNEL, no_targets, tables


def test_stream_equals_batch_and_replays_change_nothing(spark, tmp_path):
    sources = tables(spark, company=[FENNEL, ("recCo2", None, "C-2", "Beta", "beta.com", None, None)],
                     contact=[("recP1", None, None, "Nell", None, "nell@fennel.example", None, "C-1", ["recCompany1"])])
    bodies = [
        {"table": "Companies", "recordId": "recCo2"}, {"tableName": "contacts", "id": "recP1"},
        {"table": "Companies", "recordId": "recCo2"}, {"table": "Invoices", "recordId": "recCo2"},
        {"table": "Companies", "recordId": "recCompany1"}, {"tableName": "contacts", "id": "recP1"},
    ]
    rows = [(i, json.dumps(b)) for i, b in enumerate(bodies)]
    schema = "event_id bigint, body string"
    for part, chunk in enumerate((rows[:3], rows[3:])):  # two files, one micro-batch each
        spark.createDataFrame(chunk, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))

    log = SyncLog(spark, str(tmp_path / "log")).start_from(no_targets(spark))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    job = event_stream(stream, lambda: sources, log, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    job.awaitTermination(600)
    assert job.exception() is None

    batch = sync_events(event_fields(spark.createDataFrame(rows, schema)), sources, no_targets(spark), seq="event_id")
    for object_type in (C.COMPANIES, C.CONTACTS):
        want = batch.merged(object_type).drop("action").collect()
        assert sorted(log.target(object_type).collect()) == sorted(want)
    assert log.target(C.COMPANIES).count() == 2 and log.target(C.CONTACTS).count() == 1
    assert sorted(log.edges().collect()) == sorted(batch.edges.collect())
    assert log.outcomes().where("status = 'failed'").count() == 1
    assert log.outcomes().count() == len(bodies)


def test_doorbell_scans_for_authentic_messages_only(spark, tmp_path):
    secret = base64.b64encode(b"a secret of this test").decode()
    sign = lambda body: "hmac-sha256=" + hmac.new(base64.b64decode(secret), body.encode(), hashlib.sha256).hexdigest()
    sources = tables(spark, company=[FENNEL, *[(f"rec{k}", None, f"K{k}", f"Name {k}", None, None, None) for k in range(300)]])
    messages = [("forged", "hmac-sha256=00", "2026-01-01 00:05:00"), ("ring", sign("ring"), "2026-01-01 00:05:00")]
    for part, message in enumerate(messages):
        spark.createDataFrame([message], "body string, header string, received string").selectExpr(
            "body", "header", "cast(received as timestamp_ntz) as received").coalesce(1).write.parquet(str(tmp_path / f"in/p={part}"))
    log = SyncLog(spark, str(tmp_path / "log")).start_from(no_targets(spark))
    before = {entry.name for entry in os.scandir(f"{shared_folder(spark).removeprefix('file:')}/recordmill")}
    counts = []
    for part in range(2):
        stream = spark.readStream.schema("body string, header string, received timestamp_ntz").parquet(str(tmp_path / f"in/p={part}"))
        job = doorbell_stream(stream, secret, lambda: sources, log, str(tmp_path / f"checkpoint{part}")).trigger(
            availableNow=True).start()
        job.awaitTermination(600)
        assert job.exception() is None
        counts.append(log.target(C.COMPANIES).count())
    # no cap: all 301 records modified within the lookback, which also covers a message that was missed
    assert counts == [0, 301]
    # what the micro-batches pinned is gone
    assert {entry.name for entry in os.scandir(f"{shared_folder(spark).removeprefix('file:')}/recordmill")} <= before

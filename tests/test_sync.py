"""Change sync on small tables."""

import pytest
from pyspark.sql import functions as F

from recordmill import contract as C
from recordmill.functions import event_fields
from recordmill.operators import lookup as lookups
from recordmill.operators import merge as M
from recordmill.operators import report as P
from recordmill.operators.identity import new_id, resolve
from recordmill.plans.pins import pin
from recordmill.plans.sync import SPECS, rescan, rescan_changes, sync, sync_events

COLUMNS = {
    C.COMPANY: "record_id string, hubspot_record_id string, company_id string, company_name string, domain string, industry string, number_of_employees string",
    C.CONTACT: "record_id string, hubspot_record_id string, contact_id string, first_name string, last_name string, email string, phone string, company_id string, Company array<string>",
    C.DEAL: "record_id string, hubspot_record_id string, deal_id string, deal_name string, amount string, status string, close_date string, company_id string, Company array<string>",
    C.LINE_ITEM: "record_id string, hubspot_record_id string, product_name string, quantity string, unit_price string, deal_id string, Deal array<string>",
}
FENNEL = ("recCompany1", None, "C-1", "Fennel Forge", "https://www.fennel.example", "Technology", "64")


def tables(spark, **rows):
    out = {}
    for entity, schema in COLUMNS.items():
        out[entity] = spark.createDataFrame(rows.get(entity, []), schema).withColumn(
            "last_modified", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    return out


def no_targets(spark, **rows):
    return {t: spark.createDataFrame(rows.get(t, []), ", ".join(f"{c} string" for c in M.target_columns(t)))
            for t in C.OBJECT_TYPES}


def changes(spark, *items):
    rows = [(i, e, r, f) for i, (e, r, f) in enumerate([(*x, None) if len(x) == 2 else x for x in items])]
    return spark.createDataFrame(rows, "seq bigint, entity string, record_id string, fields string")


def outcomes(result):
    return {r.seq: r for r in result.outcomes.collect()}


def test_company(spark):
    src = tables(spark, company=[FENNEL, ("recOdd", None, None, "Kite Co", None, "Kite Tuning", None),
                                 ("recNone", None, "C-9", None, None, None, None), ("recBlank",) + ("",) * 6])
    result = sync(changes(spark, ("company", "recCompany1"), ("company", "recOdd"), ("company", "recNone"),
                          ("company", "recBlank"), ("company", "recGone"), ("company", "recCompany1")),
                  src, no_targets(spark))
    got = outcomes(result)
    assert [(got[i].status, got[i].code, got[i].reason) for i in range(6)] == [
        ("synced", None, None), ("synced", None, None),
        ("failed", "VALIDATION_ERROR", "company_name is required to sync a Company"),
        ("skipped", None, "blank_record"), ("skipped", None, "record_not_found"), ("synced", None, None)]
    merged = {r.external_source_id: r for r in result.merged("companies").collect()}
    fennel = merged["airtable:companies:recCompany1"]
    assert (fennel.domain, fennel.numberofemployees, fennel.industry) == (
        "fennel.example", "64", "INFORMATION_TECHNOLOGY_AND_SERVICES")
    assert merged["airtable:companies:recOdd"].industry is None and len(merged) == 2
    backs = {r.record_id: r.target_id for r in result.write_backs("companies").collect()}
    assert backs["recCompany1"] == fennel.id
    stored = M.apply_write_backs(src["company"], result.write_backs("companies"))
    assert stored.where("record_id = 'recCompany1'").first().hubspot_record_id == fennel.id


def test_children_and_their_parents(spark):
    deal = ("recDeal1", None, "D-1", "Forge refit", "$3,150", "Won", "10-28-2017", "C-1", ["recCompany1"])
    src = tables(
        spark, company=[FENNEL, ("recBad", None, "C-2", "", "x.com", None, None)], deal=[deal],
        contact=[("recContact1", None, "CT-1", "Nell", "Harrow", "Nell.Harrow@FENNEL.example", None, "C-1", ["recCompany1"]),
                 ("recContact2", None, "CT-2", "No", "Parent", "b@fennel.example", None, "nope", None),
                 ("recContact3", None, "CT-3", "Bad", "Parent", "c@fennel.com", None, "C-2", []),
                 ("recContact4", None, "CT-4", "No", "Mail", None, None, None, None)],
        line_item=[("recLine1", None, "Boiler valve", "4", "75", "D-1", ["recDeal1"]),
                   ("recLine2", None, "Widget", None, None, None, None)])
    result = sync(changes(spark, ("line_item", "recLine1"), ("line_item", "recLine2"), ("contact", "recContact1"),
                          ("contact", "recContact2"), ("contact", "recContact3"), ("contact", "recContact4"),
                          ("line_item", "recLine1")), src, no_targets(spark))
    got = outcomes(result)
    assert got[0].status == got[2].status == got[3].status == got[4].status == "synced"
    assert (got[1].code, got[5].code) == ("MISSING_REFERENCE", "VALIDATION_ERROR")
    assert got[3].parent_missing and got[4].parent_missing and not got[2].parent_missing
    # the deal and the company were pulled in, one record each
    deals = result.merged("deals").collect()
    assert [(d.amount, d.dealstage, d.closedate) for d in deals] == [("3150", "closedwon", "2017-10-28")]
    assert result.merged("companies").count() == 1 and result.merged("line_items").count() == 1
    kinds = sorted((e.from_type, e.to_type) for e in result.edges.collect())
    assert kinds == [("contacts", "companies"), ("deals", "companies"), ("line_items", "deals")]
    line = result.merged("line_items").first()
    assert (line.name, line.quantity, line.price) == ("Boiler valve", "4", "75")


def test_trusted_parent_and_link_order(spark):
    src = tables(spark, company=[("recLinked", "111", "C-1", "A", None, None, None),
                                 ("recOther", "222", "C-2", "B", None, None, None)],
                 contact=[("recP1", None, None, None, None, "a@b.co", None, "C-2", ["recLinked"]),
                          ("recP2", None, None, None, None, "b@b.co", None, "C-2", [])])
    result = sync(changes(spark, ("contact", "recP1"), ("contact", "recP2")), src, no_targets(spark))
    got = outcomes(result)
    assert (got[0].parent_id, got[1].parent_id) == ("111", "222")
    assert result.merged("companies").count() == 0


def test_payload_fallback(spark):
    src = tables(spark, company=[FENNEL])
    body = '{"email": "Nell@fennel.example", "first_name": "Nell", "Company": "recCompany1"}'
    later = '{"email": "nell@fennel.example", "last_name": "L"}'
    result = sync(changes(spark, ("contact", "recX", body), ("contact", "recX", later),
                          ("contact", "recX", '{"email": ""}'), ("contact", "recY", '{"email": "no"}')),
                  src, no_targets(spark))
    got = outcomes(result)
    assert [got[i].status for i in range(4)] == ["synced", "synced", "skipped", "failed"]
    row = result.merged("contacts").collect()
    assert [(r.firstname, r.lastname, r.email) for r in row] == [("Nell", "L", "nell@fennel.example")]
    assert result.edges.count() == 1


IDENTITY = "record_id string, seq bigint, known_id string, external_id string, natural_key string"


@pytest.mark.parametrize("target,row,action,by,id_", [
    ([], (None, "ext1", "fennel.com"), "created", None, None),
    ([("77", "fennel.com", None)], ("77", "ext1", None), "updated", "hubspot_record_id", "77"),
    ([("77", "x.com", "ext1")], (None, "ext1", "fennel.com"), "updated", "external_source_id", "77"),
    ([("77", "fennel.com", None)], (None, "ext1", "fennel.com"), "updated", "natural_key", "77"),
    ([], ("999999", "ext1", "nowhere.com"), "created", None, None),
    ([("1", "fennel.com", None), ("2", "x.com", "ext1"), ("3", "y.com", None)], ("3", "ext1", "fennel.com"),
     "updated", "hubspot_record_id", "3"),
])
def test_tiers(spark, target, row, action, by, id_):
    rows = spark.createDataFrame([("r1", 0, *row)], IDENTITY)
    tgt = spark.createDataFrame(target, "id string, domain string, external_source_id string")
    got = resolve(rows, tgt, "domain").first()
    assert (got.action, got.matched_by) == (action, by)
    if id_:
        assert got.target_id == id_


def test_new_rows_with_one_natural_key(spark):
    rows = spark.createDataFrame([("r1", 2, None, "e1", "a.com"), ("r2", 1, None, "e2", "a.com"),
                                  ("r3", 3, None, "e3", None)], IDENTITY)
    tgt = spark.createDataFrame([], "id string, domain string, external_source_id string")
    got = {r.record_id: r for r in resolve(rows, tgt, "domain").collect()}
    assert got["r1"].target_id == got["r2"].target_id != got["r3"].target_id
    assert [(got[r].action, got[r].matched_by) for r in ("r1", "r2", "r3")] == [
        ("updated", "natural_key"), ("created", None), ("created", None)]


def test_taken_id_is_salted(spark):
    tgt = spark.range(1).select(new_id(F.lit("e1")).alias("id"), F.lit("b.com").alias("domain"),
                                F.lit("e9").alias("external_source_id"))
    got = resolve(spark.createDataFrame([("r1", 0, None, "e1", "a.com")], IDENTITY), tgt, "domain", "7").first()
    assert got.action == "created" and got.target_id != tgt.first().id


def test_replay(spark):
    src = tables(spark, company=[FENNEL])
    ask = changes(spark, *[("company", "recCompany1")] * 10)
    first = sync(ask, src, no_targets(spark))
    after = pin(first.merged("companies").drop("action"))
    second = sync(ask, src, {**no_targets(spark), "companies": after})
    assert after.count() == 1
    assert second.merged("companies").drop("action").collect() == after.collect()
    assert {(o.action, o.matched_by) for o in second.outcomes.collect()} == {("updated", "external_source_id")}


def test_events_delivered_again_have_one_outcome(spark):
    src = tables(spark, company=[FENNEL])
    events = spark.createDataFrame([
        (1, '{"table":"Companies","recordId":"recGone","fields":{"company_name":"Gone Ltd"}}'),
        (2, '{"table":"Companies","recordId":"recCompany1"}'), (3, "no json"), (None, "no json"), (None, "no json"),
    ], "event_id bigint, body string")
    result = sync_events(event_fields(events.union(events).union(events)), src, no_targets(spark), seq="event_id")
    rows = result.outcomes.collect()
    assert sorted((r.seq or 0, r.status, r.permanent) for r in rows) == [
        *[(0, "failed", True)] * 6, (1, "synced", False), (2, "synced", False), (3, "failed", True)]
    assert {r.run_id for r in rows} == {"0"} and result.merged("companies").count() == 2


def test_unknown_tables_fail(spark):
    got = outcomes(sync(changes(spark, ("company", "recCompany1"), ("invoice", "recI"), (None, "recN")),
                        tables(spark, company=[FENNEL]), no_targets(spark)))
    assert [(got[k].status, got[k].code) for k in range(3)] == [("synced", None), *[("failed", "VALIDATION_ERROR")] * 2]
    assert '"invoice"' in got[1].reason


def test_equal_times_do_not_decide_by_chance(spark):
    rows = spark.createDataFrame([(f"r{k}", 1, None, f"e{k}", "a.com") for k in range(30)], IDENTITY)
    tgt = spark.createDataFrame([], "id string, domain string, external_source_id string")
    for parts in (1, 7):
        made = resolve(rows.repartition(parts), tgt, "domain").where("action = 'created'").collect()
        assert [r.record_id for r in made] == ["r0"]


def test_rescan(spark):
    src = tables(spark, company=[FENNEL, ("recBad", None, "C-3", "", "b.com", None, None),
                                 ("recGood2", None, "C-4", "G2", None, None, None), ("recBlank",) + ("",) * 6],
                 deal=[("recD1", None, "D-1", "Deal", None, None, None, None, None)])
    result = rescan(src, no_targets(spark), "2025-12-31 23:50:00")
    row = P.rescan_tally(result.outcomes).first()
    assert (row.scanned, row.synced, row.skipped, row.failed) == (5, 3, 1, 1)
    assert P.rescan_tally(rescan(src, no_targets(spark), "2026-01-01 00:00:00").outcomes).first().scanned == 0


def test_events_to_changes(spark):
    df = spark.createDataFrame([('{"table":"Companies","recordId":"recA","fields":{"company_name":"X"}}',)], "body string")
    assert event_fields(df).first().fields == '{"company_name":"X"}'
    assert set(SPECS) == set(C.ENTITIES)


def test_records_are_written_once_and_moved_without_their_data(spark):
    deal = ("recDeal1", None, "D-1", "Forge refit", "$3,150", "Won", "10-28-2017", "C-1", ["recCompany1"])
    src = tables(spark, company=[FENNEL], deal=[deal])
    kept = []
    result = sync(changes(spark, ("deal", "recDeal1")), src, no_targets(spark), keep=lambda df: kept.append(df.columns) or pin(df))
    assert outcomes(result)[0].status == "synced" and result.merged("deals").first().closedate == "2017-10-28"
    assert not any("props" in columns for columns in kept)
    assert sum("deal_name" in columns for columns in kept) == 1
    assert {"record_id", "deal_name", "props", "work_key", "target_id", "parent_id", "in_source"} <= set(result.written["deals"].columns)
    found = rescan_changes(src, "2020-01-01 00:00:00")
    assert found.count() == 2 and "rangepartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_changes_of_lost_records_and_of_no_record(spark, monkeypatch):
    items = [("company", "recCompany1"), ("company", None), ("company", "recGone"),
             ("company", "recGone", '{"company_name": "Kept"}'), ("company", "recGone"), ("company", "recCompany1")]
    for most in (lookups.BROADCAST_BYTES, 0):
        monkeypatch.setattr(lookups, "BROADCAST_BYTES", most)
        got = outcomes(sync(changes(spark, *items), tables(spark, company=[FENNEL]), no_targets(spark)))
        assert [(got[i].status, got[i].reason) for i in range(6)] == [
            ("synced", None), *[("skipped", "record_not_found")] * 2, ("synced", None), ("skipped", "record_not_found"), ("synced", None)]


def test_matches_are_written_only_where_an_own_id_is_taken(spark, monkeypatch):
    from recordmill.operators import identity

    written = []
    monkeypatch.setattr(identity, "pin", lambda df: written.append(df) or pin(df))
    rows = spark.createDataFrame([(f"r{n}", n, None, f"x:{n}", None) for n in range(4)],
                                 "record_id string, seq bigint, known_id string, external_id string, natural_key string")
    target = spark.createDataFrame([("T1", "x:1")], f"id string, {C.EXTERNAL_ID} string")
    got = {r.record_id: (r.target_id, r.action) for r in resolve(rows, target, None).collect()}
    own = {f"r{n}": r.id for n, r in enumerate(rows.orderBy("seq").select(new_id(F.col("external_id")).alias("id")).collect())}
    assert not written and got == {r: ("T1", "updated") if r == "r1" else (own[r], "created") for r in own}
    held = target.unionByName(spark.createDataFrame([(own["r2"], "other")], target.schema))
    again = {r.record_id: r.target_id for r in resolve(rows, held, None).collect()}
    assert written and again["r2"] not in (own["r2"], None) and again["r3"] == own["r3"]

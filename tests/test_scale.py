"""Operators that deal one large thing out to many tasks: a file, a key's values, a scan, an order."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from recordmill.operators import lookup as lookups
from recordmill.operators.batches import numbered_batches, range_sliced, slices_for
from recordmill.operators.lookup import few, hot_keys, lookup, relevant
from recordmill.operators.merge import fold_changes
from recordmill.operators.report import attempt_signals, percentiles
from recordmill.plans.pins import pin
from recordmill.session import tune
from recordmill.sources import modified_since, read_csv, read_csv_by_records, read_table, scan_pages, tables
from recordmill.sources.records import cursor


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def export(rng, rows, end):
    """A CSV text with line breaks, quotes and commas in its values; some longer than a range."""
    def value():
        kind = rng.randrange(6)
        plain = "".join(rng.choice("abcé  ") for _ in range(rng.choice([0, 3, 30]))).strip()
        if kind < 3:
            return plain
        inner = plain + rng.choice(["\n", "\n\n", '""', ", ", '""\n""', "x" * 150, ("line\n" * 60)])
        return f'"{inner}{plain}"'
    lines = ["﻿id, first ,\"se\ncond\""] + [f"{k},{value()},{value()}" for k in range(rows)]
    return end.join(lines) + rng.choice(["", end])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_file_read_by_many_tasks_has_the_same_records(spark, tmp_path, small_ranges, end):
    rng = random.Random(1)
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text(export(rng, 120, end), encoding="utf-8", newline="")
    made = read_csv_by_records(spark, f"{tmp_path}/*.csv", ordinal="place")
    assert spark.read.text(f"{tmp_path}/*.csv").rdd.getNumPartitions() > 50
    want = read_csv(spark, f"{tmp_path}/*.csv")
    assert made.columns == [*want.columns, "place"] == ["id", "first", "se\ncond", "place"]
    assert sorted(map(repr, made.drop("place").collect())) == sorted(map(repr, want.collect()))
    order = [r.id for r in made.where(F.col("place.file").endswith("a.csv")).orderBy("place").collect()]
    assert order == [str(k) for k in range(120)]


def test_torn_missing_and_empty_files(spark, tmp_path, small_ranges):
    (tmp_path / "torn.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="torn.csv"):
        read_csv_by_records(spark, str(tmp_path / "torn.csv"))
    with pytest.raises(FileNotFoundError):
        read_csv_by_records(spark, str(tmp_path / "none.csv"))
    (tmp_path / "bare.csv").write_text("a,b\n")
    assert read_csv_by_records(spark, str(tmp_path / "bare.csv")).collect() == []
    (tmp_path / "short.csv").write_text("a,b\n\n1\n2, y ,z\n")
    assert sorted(map(tuple, read_csv_by_records(spark, str(tmp_path / "short.csv")).collect())) == [("1", None), ("2", "y")]


def test_percentiles_are_exact(spark):
    rng = random.Random(2)
    rows = [("hot", rng.random()) for _ in range(3000)] + [("hot", 0.5)] * 500 + [(None, 1.0), (None, 3.0), ("one", -2.5), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in percentiles(frame, ["k"], "v", {"low": 0.0, "mid": 0.5, "p95": 0.95, "top": 1.0}).collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    cuts = statistics.quantiles(hot, n=100, method="inclusive")
    assert got["hot"].low == hot[0] and got["hot"].top == hot[-1]
    assert got["hot"].mid == pytest.approx(cuts[49], abs=1e-12) and got["hot"].p95 == pytest.approx(cuts[94], abs=1e-12)
    assert got[None].mid == 2.0 and got["one"].p95 == -2.5 and "none" not in got
    signals = attempt_signals(frame.select("k", F.lit(429).alias("status"), F.col("v").alias("duration")), ["k"])
    rows = {r.k: (r.attempts, r.throttled, r.p50) for r in signals.collect()}
    assert rows["none"] == (1, 1, None) and rows[None] == (2, 2, 2.0) and rows["hot"][0] == 3500


def test_pages_of_a_scan_join_without_a_gap(spark):
    table = spark.range(103).select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("record_id"), F.expr(
        "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id % 4 as int))").alias("last_modified"))
    whole = [r.record_id for r in modified_since(table, "2024-01-01 00:00:00").collect()]
    assert len(whole) == 77  # four different times only
    for size in (7, 11, 77, 100):
        pages = list(scan_pages(table, "2024-01-01 00:00:00", size))
        assert [r.record_id for p in pages for r in p.collect()] == whole
        assert all(p.count() == size for p in pages[:-1])
    first = next(scan_pages(table, "2024-01-01 00:00:00", 30))
    rest = [r.record_id for p in scan_pages(table, "2024-01-01 00:00:00", 30, cursor(first)) for r in p.collect()]
    assert rest == whole[30:]
    assert list(scan_pages(table, "2030-01-01 00:00:00", 5)) == [] and cursor(table.limit(0)) is None
    with pytest.raises(ValueError):
        next(scan_pages(table, "2024-01-01 00:00:00", 0))


def test_a_scan_in_many_pages_reads_the_table_once(spark, monkeypatch):
    from recordmill.sources import records

    written = []
    monkeypatch.setattr(records, "pin", lambda df: written.append(df) or pin(df))
    table = spark.range(60).selectExpr("concat('r', id % 50) as record_id", "timestamp_ntz '2024-01-02 00:00:00' as last_modified")
    pages = list(scan_pages(table, "2024-01-01 00:00:00", 3))
    assert len(pages) == 20 and len(written) == 1
    assert sorted(r.record_id for p in pages for r in p.collect()) == sorted(r.record_id for r in table.collect())


def test_large_files_are_read_as_they_lie(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    assert read_table(spark, str(tmp_path / "t"), 3).rdd.getNumPartitions() == 3
    monkeypatch.setattr(tables, "BYTES_PER_TASK", 1)
    table = read_table(spark, str(tmp_path / "t"), 3)
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString() and table.count() == 1000


def test_hot_keys_are_found_by_their_hash(spark):
    rows = spark.range(5000).selectExpr("case when id % 10 = 0 then null when id % 2 = 0 then 'hot' else concat('k', id) end as k")
    assert [tuple(r) for r in hot_keys(rows, F.col("k"), 500).collect()] == [("hot", 4)]
    assert hot_keys(rows, F.col("k"), 2000) is None


def test_few_keys_filter_a_table_without_a_shuffle(spark):
    parents = spark.range(1000).selectExpr("concat('k', id) as id", "id as n")
    keys = spark.createDataFrame([("k1",), ("k1",), (None,), ("none",), ("k7",)], "k string")
    found = relevant(parents, "id", keys)
    assert sorted(r.n for r in found.collect()) == [1, 7]
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()
    assert relevant(parents, "id", keys, exact=False).count() == 2


def test_many_or_long_keys_are_not_broadcast(spark, monkeypatch):
    parents = spark.range(1000).selectExpr("concat('k', id) as id", "id as n")
    keys = spark.range(0, 1000, 10).selectExpr("concat('k', id) as k")
    assert few(keys)
    with monkeypatch.context() as m:
        m.setattr(lookups, "BROADCAST_BYTES", 9_700, raising=False)
        assert not few(keys) and relevant(parents, "id", keys).count() == 100
    assert not few(spark.range(700_000).selectExpr("concat('k', id) as k"))
    assert not few(spark.range(700).selectExpr("repeat(cast(id % 10 as string), 100000) as k"))


def test_a_small_file_of_many_rows_is_not_broadcast(spark):
    session = tune(spark.newSession())
    rows, ids = (pin(session.range(1_000_000).selectExpr("concat('rec', id) as id", f"id as {n}")) for n in "ab")
    joined = rows.join(ids, "id", "left")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.where("a = b").count() == 1_000_000
    narrow = spark.newSession()
    narrow.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    assert tune(narrow).conf.get("spark.sql.autoBroadcastJoinThreshold") == "256k"
    assert tune(session).conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == str(10 << 20)


def test_changes_are_folded_by_property(spark):
    rng = random.Random(5)
    names = ["name", "quantity", "price", "external_source_id", "external_source_system"]
    rows = [(rng.choice(["a", "b", "c", "d", None]), rng.choice([None, 1, 2, 3]), f"r{n:03}",
             tuple(rng.choice([None, "x", "y", "z"]) if rng.random() < 0.3 else f"{p}{n}" for p in names)) for n in range(300)]
    frame = spark.createDataFrame(rows, f"target_id string, seq bigint, record_id string, props struct<{', '.join(f'{n}: string' for n in names)}>")
    want = {}
    for target, _, _, values in sorted((r for r in rows if r[0]), key=lambda r: (r[1] or 0, r[2])):
        want[target] = tuple(new if new is not None else old for new, old in zip(values, want.get(target, (None,) * 5)))
    assert {r.id: tuple(r[n] for n in names) for r in fold_changes(frame, "line_items").collect()} == want


@pytest.mark.parametrize("text", [True, False])
def test_rows_without_a_key_meet_no_parent(spark, text):
    kind = "string" if text else "bigint"
    rows = spark.range(400).selectExpr("id", f"cast(case when id % 4 > 0 then id end as {kind}) as k")
    parents = spark.range(1 << 16).selectExpr(f"cast(id as {kind}) as p", "id as n")  # every spread number is a key
    found = lookup(rows, parents, F.col("k"), "p", {"n": "n"}, ["id"]).collect()
    assert {r.id: r.n for r in found} == {n: n if n % 4 else None for n in range(400)} and len(found) == 400


@pytest.mark.parametrize("rows", [3_000, 12_000])
def test_slices_follow_the_rows(spark, rows):
    frame = spark.range(rows).selectExpr("id * 7919 % 1000003 as k")
    assert slices_for(frame, 500) == rows // 500
    sizes = [r["count"] for r in range_sliced(frame, ["k"], 500).groupBy("_slice").count().collect()]
    assert sum(sizes) == rows and max(sizes) <= 2 * 500
    made = sorted((r.k, r.ordinal, r.batch_no) for r in numbered_batches(frame, "k", 100, rows_per_slice=500).collect())
    assert [(o, b) for _, o, b in made] == [(n + 1, n // 100) for n in range(rows)]

"""Lookups under skew, numbering, edges, uniqueness."""

import pytest
from pyspark.sql import functions as F

from recordmill.operators import edges as E
from recordmill.operators.batches import numbered_batches
from recordmill.operators.lookup import first_by, hot_keys, lookup, relevant
from recordmill.operators.mapping import map_company_csv
from recordmill.operators.validate import duplicates, is_blank
from recordmill.sources import modified_since


def test_hot_keys_are_split_and_nothing_is_lost(spark):
    # a third of all rows on one key, a third without a key, some without a parent
    children = spark.range(900).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id"))).alias("fk"))
    parents = spark.range(0, 900, 2).select(F.concat(F.lit("k"), F.col("id")).alias("pk"), F.col("id").alias("v")).union(
        spark.createDataFrame([("hot", -1)], "pk string, v bigint"))
    hot = {r["_hot"]: r["_parts"] for r in hot_keys(children, F.col("fk"), 50).collect()}
    assert hot == {"hot": 6}
    args = (children, parents, F.col("fk"), "pk", {"found": "v"}, ["id"])
    salted = lookup(*args, rows_per_task=50)
    plain = lookup(*args)
    assert salted.columns == plain.columns == ["id", "fk", "found"]
    assert sorted(map(repr, salted.collect())) == sorted(map(repr, plain.collect()))
    assert salted.where("fk = 'hot' and found = -1").count() == 300


def test_first_by_and_relevant(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 0, "z"), ("b", 5, "w")], "k string, o int, v string")
    assert {r.first_key: r.v for r in first_by(df, F.col("k"), "o", ["v"]).collect()} == {"a": "y", "b": "w"}
    keys = spark.createDataFrame([("b",), ("b",), (None,)], "q string")
    assert [r.v for r in relevant(df, "k", keys).collect()] == ["w"]


@pytest.mark.parametrize("n,size,want", [(5, 2, [2, 2, 1]), (0, 2, []), (4, 2, [2, 2])])
def test_chunks(spark, n, size, want):
    rows = numbered_batches(spark.range(n), "id", size).collect()
    assert [sum(r.batch_no == b for r in rows) for b in range(len(want))] == want
    assert sorted((r.id, r.ordinal) for r in rows) == [(i, i + 1) for i in range(n)]


def test_chunk_size(spark):
    with pytest.raises(ValueError):
        numbered_batches(spark.range(1), "id", 0)


def test_edges_are_a_set(spark):
    one = spark.createDataFrame([("contacts", "1", "companies", "2")] * 2, ", ".join(f"{c} string" for c in E.EDGE))
    assert E.add_edges(one, one).count() == 1
    assert E.new_edges(one.limit(0), one).count() == 1 and E.new_edges(one, one).count() == 0


def test_blank_rows(spark):
    rows = [("", None, None, []), ("x", "m", "12345", None), ("", None, None, ["recX"]), (None, "m", "1", None), ("0", None, None, None)]
    df = spark.createDataFrame(rows, "deal_name string, last_modified string, hubspot_record_id string, Company array<string>")
    assert [r.b for r in df.select(is_blank(df).alias("b")).collect()] == [True, False, False, True, False]


def test_duplicates(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    assert [tuple(r) for r in duplicates(df, "k").collect()] == [("a", 2)]


def test_modified_since(spark):
    df = spark.sql("select concat('r', id) as record_id, timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int)) as last_modified from range(5)")
    assert [r.record_id for r in modified_since(df, "2024-01-01 00:01:00", 2).collect()] == ["r2", "r3"]
    assert modified_since(df, "2024-01-01 00:01:00", None).count() == 3


def test_company_warnings(spark):
    df = spark.createDataFrame([("1", "A", "https://", "Nonsense", "lots"), ("2", " ", "a.com", None, None)],
                               "company_id string, company_name string, domain string, industry string, number_of_employees string")
    good, bad = map_company_csv(df).orderBy("company_id").collect()
    assert good.warnings == ['Could not normalise domain "https://"', 'Could not parse number_of_employees "lots"',
                             'Industry "Nonsense" is not a HubSpot value, omitted']
    assert good.error is None and bad.warnings == [] and "company_name" in bad.error

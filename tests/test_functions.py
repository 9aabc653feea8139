"""Value tables of the cleansing expressions."""

import hashlib
import hmac
import base64

import pytest
from pyspark.sql import functions as F

from recordmill import functions as R


def run(spark, expr, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", expr(F.col("v")).alias("out"))
    return [r.out for r in sorted(df.collect(), key=lambda r: r.i)]


def check(spark, expr, table, kind="string"):
    got = run(spark, expr, [k for k, _ in table], kind)
    assert [(k, g) for (k, _), g in zip(table, got)] == table


def test_dates(spark):
    check(spark, R.parse_date, [
        # day and month can only be told apart by one above 12; otherwise the month comes first
        ("7/30/1999", "1999-07-30"), ("30/7/1999", "1999-07-30"), ("3-8-2010", "2010-03-08"), ("8/3-2010", "2010-08-03"),
        ("28-02-2015", "2015-02-28"), ("02-28-2015", "2015-02-28"), ("29/02/2015", None), ("29/02/2016", "2016-02-29"),
        # year first
        ("1987-12-01", "1987-12-01"), ("1987/2/9", "1987-02-09"), ("1987/02/09", "1987-02-09"), ("1987-2-9", None),
        ("1900/02/29", None), ("2000/02/29", "2000-02-29"), ("1987-04-31", None), ("1987-00-10", None), ("1987/13/1", None),
        # no day
        ("5/2031", "2031-05-01"), ("10-2031", "2031-10-01"), ("2031-10", "2031-10-01"), ("2031/5", "2031-05-01"), ("14/2031", None),
        # names of months
        ("october 1812", "1812-10-01"), ("SEPT. 1812", "1812-09-01"), ("1812 Jan", "1812-01-01"), ("1812  february", "1812-02-01"),
        ("aug.   1812", "1812-08-01"), ("Octember 1812", None), ("Octo 1812", None),
        # blanks, short years, and what is no date
        ("\u00a0 1987-12-01\t", "1987-12-01"), ("1987-12-01\u0085", None), ("~1987-2-9", None), ("0057-03-04", None),
        ("0812-03-04", "812-03-04"), ("2/2/2", None), ("00/11/1987", None), ("soon", None), ("", None), (None, None),
    ])


def test_amounts(spark):
    check(spark, R.parse_amount, [
        ("€ 7,350", 7350.0), ("EUR 12.75", 12.75), ("2,000,000.5 kg", 2000000.5), ("31", 31.0), ("- 4.25", -4.25),
        ("(720)", 720.0), ("3e4", 34.0), ("8-9", 8.0), ("6.7.8", 6.7), ("9.", 9.0), (".75", 0.75), ("-.75", -0.75),
        ("free", None), ("--8", None), ("-", None), (".", None), ("-.", None), ("7" * 400, None), ("", None), (None, None),
    ])
    check(spark, R.parse_integer, [
        ("521", 521), ("6,400 people", 6400), ("7.99", 7), ("-7.99", -7), ("many", None), ("8" * 25, None),
    ])


def test_number_text(spark):
    check(spark, R.number_text, [
        (48469.0, "48469"), (12345678.5, "12345678.5"), (1e20, "100000000000000000000"),
        (1e21, "1e+21"), (0.0, "0"), (-0.0, "0"), (0.001, "0.001"), (0.0005, "0.0005"),
        (1e-6, "0.000001"), (1.5e-7, "1.5e-7"), (-3.0, "-3"), (10000000.0, "10000000"),
        (1.0, "1"), (None, None), (309974.59, "309974.59"),
    ], "double")


def test_booleans(spark):
    check(spark, R.parse_boolean, [
        ("1", True), ("True", True), ("yes", True), ("Y", True), ("true", True), (" t ", True),
        ("0", False), ("False", False), ("No", False), ("n", False), ("false", False),
        ("maybe", None), ("", None), (None, None),
    ])


def test_contact_fields(spark):
    check(spark, R.normalise_email, [
        ("  Hope.Beer@DuffWorks.com ", "hope.beer@duffworks.com"), ("not-an-email", None),
        ("a b@c.de", None), ("a@b@c.de", None), ("a@b", None), ("", None), (None, None),
        ("a@b.c d", None), ("a@b.c\n", "a@b.c"),
    ])
    check(spark, R.normalise_domain, [
        ("https://www.acme.com/pricing", "acme.com"), ("HOOLICORP.COM", "hoolicorp.com"),
        ("http://acme.com:80?x=1", "acme.com:80?x=1"), ("www.www.acme.com", "www.acme.com"),
        ("/only/path", None), ("", None), (None, None), ("https://", None), ("  www.a.b/ ", "a.b"),
        ("ftp://www.a.b", "ftp:"),
    ])
    check(spark, R.clean_phone, [
        ("+1-555-0537", "15550537"), ("555.0611", "5550611"), ("n/a", None), ("", None), (None, None),
    ])


def test_categories(spark):
    check(spark, R.clean_industry, [
        ("Biotech", "BIOTECHNOLOGY"), ("Food & Beverage", "FOOD_BEVERAGES"),
        ("telecom", "TELECOMMUNICATIONS"), ("real  - estate", "REAL_ESTATE"),
        ("INFORMATION_TECHNOLOGY_AND_SERVICES", "INFORMATION_TECHNOLOGY_AND_SERVICES"),
        ("Underwater Basket Weaving", None), ("OTHER", None), ("", None), (None, None), (" R&D ", "RESEARCH"),
        ("constructor", None),
    ])
    check(spark, R.stage_of_status, [
        ("Won", "closedwon"), ("  won ", "closedwon"), ("closed_won", "closedwon"),
        ("Lost", "closedlost"), ("CLOSED-LOST", "closedlost"), ("Open", "qualifiedtobuy"),
        ("In Progress", "qualifiedtobuy"), ("", "qualifiedtobuy"), (None, "qualifiedtobuy"),
    ])
    check(spark, R.clean_deal_stage, [
        ("closedwon", "closedwon"), ("decisionmakerboughtin", "decisionmakerboughtin"),
        (" ClosedLost", "closedlost"), ("negotiation", "qualifiedtobuy"), ("", "qualifiedtobuy"),
    ])
    check(spark, R.clean_lifecycle, [("Lead ", "lead"), ("champion", None), ("", None), (None, None)])
    check(spark, R.entity_of_table, [
        ("Companies", "company"), ("contacts", "contact"), ("Deal", "deal"),
        ("line_items", "line_item"), ("Line Items", "line_item"), ("Invoices", None), (None, None),
    ])


def test_signature(spark):
    for secret in (b"a-test-mac-secret-value", b"k" * 100):
        body = '{"base":"é"}'
        want = "hmac-sha256=" + hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()
        encoded = base64.b64encode(secret).decode()
        got = run(spark, lambda c: R.hmac_sha256_header(c, encoded), [body, None])
        assert got == [want, None]
        cases = [(body, want, True), (body + "x", want, False), (body, None, False),
                 ("", want, False), (None, want, False), (body, want[:-1] + "_", False)]
        df = spark.createDataFrame(cases, "b string, h string, ok boolean").select(
            R.is_authentic(F.col("b"), F.col("h"), encoded).alias("got"), "ok",
            R.is_authentic(F.col("b"), F.col("h"), "").alias("none"))
        assert all(r.got == r.ok and r.none is False for r in df.collect())


def test_outcomes(spark):
    rows = [(None, 429, None), (None, 500, None), (None, 503, None), (None, None, "ECONNRESET"),
            (None, None, "ETIMEDOUT"), (None, 400, None), (None, 404, None), (False, 500, "VALIDATION_ERROR"),
            (None, None, None)]
    df = spark.createDataFrame(rows, "flag boolean, status int, code string")
    got = [r.x for r in df.select(R.is_retryable(F.col("flag"), F.col("status"), F.col("code")).alias("x")).collect()]
    assert got == [True] * 5 + [False] * 4
    cases = [("VALIDATION_ERROR", None, None, 400, False), ("MISSING_REFERENCE", True, 500, 400, False),
             (None, True, 429, 429, True), (None, None, 429, 400, False), (None, None, 502, 503, True),
             (None, None, None, 503, True), (None, None, 404, 400, False)]
    df = spark.createDataFrame(cases, "code string, flag boolean, status int, want int, retry boolean")
    answer, retry = R.outcome_class(F.col("code"), F.col("flag"), F.col("status"))
    for r in df.select(answer.alias("a"), retry.alias("r"), "want", "retry").collect():
        assert (r.a, r.r) == (r.want, r.retry)


def test_first_link(spark):
    df = spark.createDataFrame(
        [(["recA", "recB"], None), ([], "recD"), (None, "plain"), (None, None), ([], None)],
        "a array<string>, s string")
    got = [r.x for r in df.select(R.first_link((F.col("a"), "array"), (F.col("s"), "string")).alias("x")).collect()]
    assert got == ["recA", "recD", None, None, None]


@pytest.mark.parametrize("body,entity,record,error", [
    ('{"table":"Companies","recordId":"recA","fields":{"x":1}}', "company", "recA", None),
    ('{"table_name":"Line Items","record":{"id":"recB","fields":{}}}', "line_item", "recB", None),
    ('{"tableName":"Companies","id":"rec123"}', "company", "rec123", None),
    ('{"table":"","table_name":"Deal","recordId":"","id":"recZ"}', "deal", "recZ", None),
    ('{"record":{"table":"contacts","recordId":"recQ"}}', "contact", "recQ", None),
    ('{"table":"Invoices","recordId":"recA"}', None, "recA", "Unknown"),
    ('{"table":"Companies"}', None, None, "record id"),
    ('{"table":"Companies","recordId":5}', None, None, "record id"),
    ('{"table":"Companies","recordId":0,"id":"recA"}', "company", "recA", None),
    ('"text"', None, None, "JSON object"), ("not json", None, None, "JSON object"),
    (None, None, None, "JSON object"), ("null", None, None, "JSON object"), ("7", None, None, "JSON object"),
    ("[1]", None, None, "Unknown"),
])
def test_events(spark, body, entity, record, error):
    row = R.event_fields(spark.createDataFrame([(body,)], "body string")).collect()[0]
    assert (row.entity, row.record_id) == (entity, record)
    assert (row.error is None) == (error is None) and (error is None or error in row.error)

"""Source rows to target properties.

A mapper adds three columns and keeps all others for the audit trail: ``props``
(a struct of text properties, null where absent), ``warnings`` and ``error``.
A row without its required field gets an error; any other bad field costs only
that field, with a warning.
"""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill import contract as C
from recordmill import functions as R
from recordmill.functions.dates import date_digits, date_shapes, real_date
from recordmill.functions.numbers import finite, leading_number, whole

Mapper = Callable[[DataFrame], DataFrame]


def given(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _props(object_type: str, source: str, system: str, key: str, values: dict[str, Column]) -> Column:
    return F.struct(
        *[R.filled(column).alias(name) for name, column in values.items()],
        R.external_id(source, object_type, F.col(key)).alias(C.EXTERNAL_ID),
        F.lit(system).alias(C.SOURCE_SYSTEM),
    )


def record_external_id(object_type: str) -> Column:
    """The external id that the record mappers give."""
    return R.external_id(C.RECORD_SOURCE, object_type, F.col("record_id"))


def _mapped(df: DataFrame, props: Column, error: Column, warnings: list[Column]) -> DataFrame:
    # props stays a projection of its own, so that a warning reads a result and does not redo it
    none = F.array().cast("array<string>")
    noted = F.concat(*[F.when(w.isNotNull(), F.array(w)).otherwise(none) for w in warnings]) if warnings else none
    return (
        df.withColumn("props", props)
        .withColumn("error", error)
        .withColumn("warnings", F.when(F.col("error").isNull(), noted).otherwise(none))
        .drop("_employees", "_amount", "_quantity", "_price", "_date")
    )


def _with_numbers(df: DataFrame, **sources: str) -> DataFrame:
    """Adds ``_<name>``, the double in each source column.

    A projection of its own for each step: an expression that a later one reads several times is computed once.
    """
    read = df.withColumns({f"_{name}": leading_number(F.col(source)) for name, source in sources.items()})
    return read.withColumns({f"_{name}": finite(F.col(f"_{name}")) for name in sources})


def _with_date(df: DataFrame, source: str) -> DataFrame:
    """Adds ``_date``, the date digits in a source column."""
    shapes = date_shapes(F.col(source))
    read = df.withColumns({f"_{name}": column for name, column in shapes.items()})
    return read.withColumn("_date", date_digits(*[F.col(f"_{name}") for name in shapes])).drop(*[f"_{n}" for n in shapes])


def _lost(source: str, prop: str, template: str) -> Column:
    """Warning for a field that was given but came to nothing."""
    return F.when(given(source) & F.col(f"props.{prop}").isNull(), R.message(template, F.col(source)))


def map_company_csv(df: DataFrame) -> DataFrame:
    df = _with_numbers(df, employees="number_of_employees").withColumn("_employees", whole(F.col("_employees")))
    props = _props(C.COMPANIES, C.CSV_SOURCE, C.CSV_SYSTEM, "company_id", {
        "name": R.trim_blanks(F.col("company_name")),
        "domain": R.normalise_domain(F.col("domain")),
        "industry": R.clean_industry(F.col("industry")),
        "numberofemployees": R.number_text(F.col("_employees")),
    })
    return _mapped(df, props, F.when(F.col("props.name").isNull(), F.lit(C.NO_COMPANY_NAME)), [
        _lost("domain", "domain", C.BAD_DOMAIN),
        _lost("number_of_employees", "numberofemployees", C.BAD_EMPLOYEES),
        _lost("industry", "industry", C.BAD_INDUSTRY),
    ])


def map_contact_csv(df: DataFrame) -> DataFrame:
    props = _props(C.CONTACTS, C.CSV_SOURCE, C.CSV_SYSTEM, "contact_id", {
        "firstname": R.trim_blanks(F.col("first_name")),
        "lastname": R.trim_blanks(F.col("last_name")),
        "email": R.normalise_email(F.col("email")),
        "phone": R.clean_phone(F.col("phone")),
        "lifecyclestage": R.clean_lifecycle(F.col("lifecycle_stage")),
    })
    error = F.when(F.col("props.email").isNull(), R.message(C.BAD_EMAIL, F.col("email")))
    # a stage of nothing but blanks is an absent one
    unknown = (R.trim_blanks(F.col("lifecycle_stage")) != "") & F.col("props.lifecyclestage").isNull()
    return _mapped(df, props, error, [
        F.when(unknown, R.message(C.BAD_LIFECYCLE, F.col("lifecycle_stage"))),
    ])


def map_deal_csv(df: DataFrame) -> DataFrame:
    df = _with_date(_with_numbers(df, amount="amount"), "close_date")
    props = _props(C.DEALS, C.CSV_SOURCE, C.CSV_SYSTEM, "deal_id", {
        "dealname": R.trim_blanks(F.col("deal_name")),
        "amount": R.number_text(F.col("_amount")),
        "dealstage": R.clean_deal_stage(F.col("deal_stage")),
        "closedate": real_date(F.col("_date")),
        "pipeline": F.lit(C.DEFAULT_PIPELINE),
    })
    # the stage was replaced, not kept: an unknown one is told by the list of known stages
    known = F.lower(R.trim_blanks(F.col("deal_stage"))).isin(C.DEAL_STAGES)
    return _mapped(df, props, F.when(F.col("props.dealname").isNull(), F.lit(C.NO_DEAL_NAME)), [
        F.when(~F.coalesce(known, F.lit(False)), R.message(C.BAD_STAGE, F.col("deal_stage"))),
        _lost("amount", "amount", C.BAD_AMOUNT),
        _lost("close_date", "closedate", C.BAD_CLOSE_DATE),
    ])


def map_company_record(df: DataFrame) -> DataFrame:
    df = _with_numbers(df, employees="number_of_employees").withColumn("_employees", whole(F.col("_employees")))
    props = _props(C.COMPANIES, C.RECORD_SOURCE, C.RECORD_SYSTEM, "record_id", {
        "name": F.col("company_name"),
        "domain": R.normalise_domain(F.col("domain")),
        "industry": R.clean_industry(F.col("industry")),
        "numberofemployees": R.number_text(F.col("_employees")),
    })
    return _mapped(df, props, F.when(~given("company_name"), F.lit(C.RECORD_NO_COMPANY_NAME)), [])


def map_contact_record(df: DataFrame) -> DataFrame:
    props = _props(C.CONTACTS, C.RECORD_SOURCE, C.RECORD_SYSTEM, "record_id", {
        "firstname": F.col("first_name"),
        "lastname": F.col("last_name"),
        "email": R.normalise_email(F.col("email")),
        "phone": R.clean_phone(F.col("phone")),
        "lifecyclestage": F.lit(None).cast("string"),
    })
    error = F.when(F.col("props.email").isNull(), R.message(C.RECORD_BAD_EMAIL, F.col("email")))
    return _mapped(df, props, error, [])


def map_deal_record(df: DataFrame) -> DataFrame:
    df = _with_date(_with_numbers(df, amount="amount"), "close_date")
    props = _props(C.DEALS, C.RECORD_SOURCE, C.RECORD_SYSTEM, "record_id", {
        "dealname": F.col("deal_name"),
        "amount": R.number_text(F.col("_amount")),
        "dealstage": R.stage_of_status(F.col("status")),
        "closedate": real_date(F.col("_date")),
        "pipeline": F.lit(C.DEFAULT_PIPELINE),
    })
    return _mapped(df, props, F.when(~given("deal_name"), F.lit(C.RECORD_NO_DEAL_NAME)), [
        _lost("close_date", "closedate", C.RECORD_BAD_CLOSE_DATE),
    ])


def map_line_item_record(df: DataFrame) -> DataFrame:
    """A line item never touches its deal's amount, so a replay cannot count it twice."""
    df = _with_numbers(df, quantity="quantity", price="unit_price")
    props = _props(C.LINE_ITEMS, C.RECORD_SOURCE, C.RECORD_SYSTEM, "record_id", {
        "name": F.col("product_name"),
        "quantity": R.number_text(F.col("_quantity")),
        "price": R.number_text(F.col("_price")),
    })
    return _mapped(df, props, F.when(~given("product_name"), F.lit(C.RECORD_NO_PRODUCT_NAME)), [])


@dataclass(frozen=True)
class CsvSpec:
    """One CSV entity: its key, its mapper, and the keys it refers to other entities by."""

    object_type: str
    key: str
    columns: list[str]
    mapper: Mapper
    parents: dict[str, str] = field(default_factory=dict)  # object type -> key column
    must_exist: str | None = None  # object type whose absence makes the row an orphan


@dataclass(frozen=True)
class RecordSpec:
    """One record table: its columns, its mapper and its parent table."""

    entity: str
    fields: list[str]
    mapper: Mapper
    parent: str | None = None
    business_key: str | None = None
    required: bool = False

    @property
    def object_type(self) -> str:
        return C.OBJECT_TYPE_OF[self.entity]

    @property
    def links(self) -> list[str]:
        return C.LINK_FIELDS[self.parent] if self.parent else []


CSV_SPECS = [
    CsvSpec(C.COMPANIES, "company_id",
            ["company_id", "company_name", "domain", "industry", "number_of_employees"],
            map_company_csv),
    CsvSpec(C.CONTACTS, "contact_id",
            ["contact_id", "first_name", "last_name", "email", "phone", "company_id", "lifecycle_stage"],
            map_contact_csv, {C.COMPANIES: "company_id"}, C.COMPANIES),
    CsvSpec(C.DEALS, "deal_id",
            ["deal_id", "deal_name", "amount", "deal_stage", "close_date", "company_id", "contact_id"],
            map_deal_csv, {C.COMPANIES: "company_id", C.CONTACTS: "contact_id"}, C.COMPANIES),
]

RECORD_SPECS = [
    RecordSpec(C.COMPANY,
               ["company_id", "company_name", "domain", "industry", "number_of_employees"],
               map_company_record),
    RecordSpec(C.CONTACT,
               ["contact_id", "first_name", "last_name", "email", "phone", "company_id"],
               map_contact_record, C.COMPANY, "company_id"),
    RecordSpec(C.DEAL,
               ["deal_id", "deal_name", "amount", "status", "close_date", "company_id"],
               map_deal_record, C.COMPANY, "company_id"),
    RecordSpec(C.LINE_ITEM,
               ["product_name", "quantity", "unit_price", "deal_id"],
               map_line_item_record, C.DEAL, "deal_id", required=True),
]

"""Change events: whatever JSON arrives, to one canonical row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill import contract as C
from recordmill.functions.categories import entity_of_table
from recordmill.functions.text import message

TABLE_PATHS = ["$.table", "$.table_name", "$.tableName", "$.record.table"]
ID_PATHS = ["$.recordId", "$.record_id", "$.id", "$.record.id", "$.record.recordId"]
FIELD_PATHS = ["$.fields", "$.record.fields"]
EVENT_PATHS = ["$.eventId", "$.event_id"]


# JSON texts that do not count as a value: null, empty, false, zero
UNSET = r'^(?:null|""|false|-?0(?:\.0+)?(?:[eE][-+]?\d+)?)\z'


def _first_set(texts: list[Column]) -> Column:
    return F.coalesce(*[F.when(~text.rlike(UNSET), text) for text in texts])


def _plain(text: Column) -> Column:
    """JSON text of a scalar without its quotes."""
    return F.when(
        text.startswith('"'), F.try_variant_get(F.try_parse_json(text), "$", "string")
    ).otherwise(text)


def event_fields(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds entity, table_name, record_id, fields (JSON text), source_event_id, error, error_code.

    A payload that cannot be read keeps its row, with the error filled in. The
    body is parsed once; each path of interest is kept as JSON text, which still
    tells a string from a number.
    """
    paths = {
        f"_{group}{i}": path
        for group, choices in (
            ("table", TABLE_PATHS), ("id", ID_PATHS), ("fields", FIELD_PATHS), ("event", EVENT_PATHS)
        )
        for i, path in enumerate(choices)
    }
    parsed = df.withColumn("_json", F.try_parse_json(F.col(body)))
    texts = parsed.select(
        "*", F.substring(F.schema_of_variant("_json"), 1, 5).alias("_kind"),
        *[F.to_json(F.try_variant_get("_json", path, "variant")).alias(c) for c, path in paths.items()],
    ).drop("_json")

    def first(group: str) -> Column:
        return _first_set([F.col(c) for c in paths if c.startswith(f"_{group}")])

    # each choice in a projection of its own, so that what reads it twice does not choose twice
    chosen = texts.select(*df.columns, "_kind", *[first(g).alias(f"_{g}") for g in ("table", "id", "fields", "event")])
    found = chosen.select(
        *df.columns, "_kind", _plain(F.col("_table")).alias("table_name"), "_id", "_fields",
        _plain(F.col("_event")).alias("source_event_id"),
    ).withColumn("_entity", entity_of_table(F.col("table_name")))
    error = (
        F.when(~F.coalesce(F.col("_kind").isin("OBJEC", "ARRAY"), F.lit(False)),
               F.lit("Request body must be a JSON object"))
        .when(F.col("_entity").isNull(), message(C.UNKNOWN_TABLE, F.col("table_name")))
        .when(~F.coalesce(F.col("_id").startswith('"'), F.lit(False)),
              F.lit("Payload is missing the record id (expected `recordId`)."))
    )
    return found.select(
        *df.columns, "table_name", "source_event_id",
        F.when(F.col("_id").startswith('"'), _plain(F.col("_id"))).alias("record_id"),
        F.when(F.col("_fields").startswith("{"), F.col("_fields")).alias("fields"),
        "_entity", error.alias("error"),
    ).select(
        *df.columns, F.when(F.col("error").isNull(), F.col("_entity")).alias("entity"),
        "table_name", "record_id", "fields", "source_event_id", "error",
        F.when(F.col("error").isNotNull(), F.lit(C.VALIDATION_ERROR)).alias("error_code"),
    )

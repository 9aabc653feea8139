"""Values of closed lists: industries, stages, statuses, tables."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordmill import contract as C
from recordmill.functions.text import BLANK_CLASS, trim_blanks


def clean_industry(value: Column) -> Column:
    """An accepted industry, by its own name or an everyday label; there is no catch-all."""
    text = trim_blanks(value)
    name = F.regexp_replace(F.upper(text), rf"[{BLANK_CLASS}-]+", "_")
    labels = F.create_map(*[F.lit(x) for pair in C.INDUSTRY_ALIASES.items() for x in pair])
    return F.when(name.isin(C.INDUSTRIES), name).otherwise(
        F.try_element_at(labels, F.lower(text))
    )


def clean_deal_stage(value: Column) -> Column:
    stage = F.lower(trim_blanks(value))
    return F.when(stage.isin(C.DEAL_STAGES), stage).otherwise(F.lit(C.DEFAULT_STAGE))


def stage_of_status(
    value: Column, won: str = C.WON_STAGE, lost: str = C.LOST_STAGE, default: str = C.DEFAULT_STAGE
) -> Column:
    status = F.regexp_replace(F.lower(trim_blanks(value)), "[_-]+", " ")
    return (
        F.when(status.isin(C.WON_STATUSES), F.lit(won))
        .when(status.isin(C.LOST_STATUSES), F.lit(lost))
        .otherwise(F.lit(default))
    )


def clean_lifecycle(value: Column) -> Column:
    stage = F.lower(trim_blanks(value))
    return F.when(stage.isin(C.LIFECYCLE_STAGES), stage)


def entity_of_table(value: Column) -> Column:
    """Entity of a table name, whatever its case, spacing and punctuation; singular or plural."""
    letters = F.regexp_replace(F.lower(value), "[^a-z]", "")
    names = {"company": C.COMPANY, "companies": C.COMPANY, "contact": C.CONTACT, "contacts": C.CONTACT,
             "deal": C.DEAL, "deals": C.DEAL, "lineitem": C.LINE_ITEM, "lineitems": C.LINE_ITEM}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), letters)

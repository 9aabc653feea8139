"""Dates in the shapes found in the wild, to ``YYYY-MM-DD`` text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordmill import contract as C
from recordmill.functions.text import BLANK_CLASS, trim_blanks

# The numeric shapes exclude one another, so one pattern recognises them all.
# Day and month are read month first. Day first is possible only where the first
# number is no month: a day over 12 in second place is no month either.
NUMERIC = (
    r"^(?:(\d{4})-(\d{2})-(\d{2})"                    # 2022-06-05
    r"|(\d{4})/(\d{1,2})/(\d{1,2})"                   # 2022/6/5
    r"|(0?\d|1[0-2])[-/](\d{1,2})[-/](\d{4})"         # 06/05/2022
    r"|(\d{1,2})[-/](\d{1,2})[-/](\d{4})"             # 17/06/2022
    r"|(\d{1,2})[-/](\d{4})"                          # 06/2022
    r"|(\d{4})[-/](\d{1,2}))\z"                       # 2022-06
)
YEAR_MONTH_DAY = "$1$4$9$12$14$15-$2$5$7$11$13$16-$3$6$8$10-"
NAMED = rf"^(?:([a-z]+)\.?[{BLANK_CLASS}]+(\d{{4}})|(\d{{4}})[{BLANK_CLASS}]+([a-z]+)\.?)\z"
YEAR_NAME = "$2$3-$1$4-"

MONTH_NUMBER = {
    name: number
    for number, full in enumerate(C.MONTHS, 1)
    for name in {full, full[:3]} | ({"sept"} if full == "september" else set())
}


def date_shapes(value: Column) -> dict[str, Column]:
    """The texts that ``date_digits`` tells a date from; a projection of their own where dates are many."""
    text = trim_blanks(value)
    return {
        "text": text, "numeric": F.regexp_replace(text, NUMERIC, YEAR_MONTH_DAY),
        "lowered": F.lower(text), "named": F.regexp_replace(F.lower(text), NAMED, YEAR_NAME),
    }


def date_digits(text: Column, numeric: Column, lowered: Column, named: Column) -> Column:
    """``YYYY-MM-DD`` as written, not yet checked against the calendar.

    Month-and-year shapes give the first of the month. A replacement that
    changed nothing did not match: what matches always gains a final dash.
    """
    numbers = F.create_map(*[
        F.lit(x) for name, number in MONTH_NUMBER.items() for x in (f"{name}-", f"-{number}")
    ])
    return F.when(numeric != text, F.rtrim(numeric, F.lit("-"))).when(
        named != lowered,
        F.concat(F.substring(named, 1, 4), F.try_element_at(numbers, F.substring(named, 6, 20))),
    )


def real_date(parts: Column) -> Column:
    # years below 100 are no dates for the source systems; years below 1000 print unpadded
    return F.when(parts >= "0100", F.ltrim(parts.try_cast("date").cast("string"), F.lit("0")))


def parse_date(value: Column) -> Column:
    """Normalised date text, or null."""
    return real_date(date_digits(**date_shapes(value)))

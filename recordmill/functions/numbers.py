"""Amounts and counts inside text, and numbers rendered back to text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

LEADING_NUMBER = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)"
LARGEST = 1.7976931348623157e308


def leading_number(value: Column) -> Column:
    """Double at the start of what remains of digits, dots and minus signs; of any size."""
    kept = F.regexp_replace(value, r"[^0-9.\-]", "")
    return F.regexp_extract(kept, LEADING_NUMBER, 0).try_cast("double")


def finite(number: Column) -> Column:
    return F.when(F.abs(number) <= LARGEST, number)


def parse_amount(value: Column) -> Column:
    """Double: what remains of digits, dots and minus signs, read as far as it is a number."""
    return finite(leading_number(value))


def whole(amount: Column) -> Column:
    return amount - amount % F.lit(1.0)


def parse_whole(value: Column) -> Column:
    """The amount truncated toward zero, still a double so that no magnitude overflows."""
    return whole(parse_amount(value))


def parse_integer(value: Column) -> Column:
    return parse_whole(value).try_cast("bigint")


def _whole(text: Column) -> Column:
    return F.when(text.endswith(".0"), F.substring_index(text, ".", 1)).otherwise(text)


def _short(text: Column) -> Column:
    """A decimal's text without closing zeros, and without its point where nothing is left behind it."""
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def number_text(number: Column) -> Column:
    """Shortest text of a double: ``48469`` and not ``48469.0``, exponents only at the extremes."""
    text = number.cast("string")
    size = F.abs(number)
    large = number.try_cast("decimal(38,10)").cast("string")
    small = number.try_cast("decimal(38,30)").cast("string")
    power = F.substring_index(text, "E", -1)
    exponent = F.concat(
        _whole(F.substring_index(text, "E", 1)),
        F.when(power.startswith("-"), F.lit("e")).otherwise(F.lit("e+")),
        power,
    )
    return (
        F.when(number == 0.0, F.lit("0"))
        .when(~text.contains("E"), _whole(text))
        .when((size >= 1e7) & (size < 1e21), _short(large))
        .when((size >= 1e-6) & (size < 1.0), _short(small))
        .otherwise(exponent)
    )

"""Strings: trimming, emails, domains, phones, booleans, ids, links, messages."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordmill import contract as C

# Every character the source systems treat as blank; Spark's own trim() knows U+0020 only.
_BLANK_POINTS = [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
BLANKS = "\t\n\x0b\f\r" + "".join(map(chr, _BLANK_POINTS))
# The same set inside a Java character class.
BLANK_CLASS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_blanks(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def filled(value: Column) -> Column:
    """The value, or null when it is empty: an empty string means absent everywhere."""
    return F.nullif(value, F.lit(""))


def message(template: str, value: Column | None = None, **fixed: str) -> Column:
    """A problem text: ``{value}`` is the row's value (empty when absent)."""
    for name, text in fixed.items():
        template = template.replace("{%s}" % name, text)
    parts = template.split("{value}")
    if len(parts) == 1:
        return F.lit(template)
    return F.concat(F.lit(parts[0]), F.coalesce(value, F.lit("")), F.lit(parts[1]))


def normalise_email(value: Column) -> Column:
    email = F.lower(trim_blanks(value))
    part = f"[^{BLANK_CLASS}@]+"
    return F.when(email.rlike(rf"^{part}@{part}\.{part}\z"), email)


def normalise_domain(value: Column) -> Column:
    """Bare host: scheme, one leading ``www.`` and everything from the first slash go."""
    noise = r"^https?://(?:www\.)?|^www\.|/[^\n\r\u2028\u2029]*\z"
    return filled(F.regexp_replace(F.lower(trim_blanks(value)), noise, ""))


def clean_phone(value: Column) -> Column:
    return filled(F.regexp_replace(value, "[^0-9]", ""))


def parse_boolean(value: Column) -> Column:
    word = F.lower(trim_blanks(value))
    return F.when(word.isin(C.TRUE_WORDS), True).when(word.isin(C.FALSE_WORDS), False)


def external_id(source: str, object_type: str, key: Column) -> Column:
    """``source:type:key``; null when there is no key."""
    return F.concat(F.lit(f"{source}:{object_type}:"), key)


def first_link(*candidates: tuple[Column, str]) -> Column:
    """First linked record id over candidate link columns.

    Each candidate is ``(column, type)`` with type ``"array"`` (its first
    element counts) or ``"string"`` (counts when it looks like a record id).
    """
    return F.coalesce(*(
        F.get(col, F.lit(0)) if kind == "array" else F.when(col.startswith("rec"), col)
        for col, kind in candidates
    ))


"""Documents that are a known licence, by the digest of a canonical form.

Texts that differ in case, punctuation, white space, copyright lines or equivalent spellings
have one canonical form. Digests of whole texts are joined with those of the known licences.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.llm.licence_texts import DIGESTS, LICENCES, TITLES
from recordmill.llm.text import ascii_lower

#: Lines that state a copyright: the word and a year, name or sign after it, with any comment marks before; or that
#: all rights are reserved.
COPYRIGHT = (r"^[ \t*#/;%-]*(?:(?:copyright[ \t]+(?:\(c\)|©|[0-9]{4}|[<\[{])|\(c\)[ \t]|©)[^\n]*"
             r"|all rights reserved\.?[ \t\r]*)$")
OTHER = r"[^\p{L}\p{N}]+"

#: Spellings that licence guidelines treat as equal.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"), ("favour", "favor"), ("honour", "honor"), ("organisation", "organization"),
    ("authorise", "authorize"), ("fulfilment", "fulfillment"), ("whilst", "while"), ("https:", "http:"), ("&", "and"),
)


def canonical(text: Column) -> Column:
    """The text in lower case (A-Z), without copyright lines, in common spelling, words parted by one blank."""
    text = F.regexp_replace(ascii_lower(text), "(?dm)" + COPYRIGHT, "")
    for spelling, common in SPELLINGS:
        text = F.replace(text, F.lit(spelling), F.lit(common))
    return F.trim(F.regexp_replace(text, OTHER, " "))


def forms() -> list[tuple[str, str]]:
    """``(licence, text)``: each known text as it is and under each of its titles."""
    return [(name, f"{title}\n\n{text}") for name, text in LICENCES.items() for title in ("", *TITLES.get(name, ()))]


def _rows(spark: SparkSession, rows: list[tuple[str, str]], second: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(t).alias(second)) for n, t in rows])
    return spark.range(1).select(F.explode(pairs).alias("x")).select("x.*")


def known_licences(spark: SparkSession) -> DataFrame:
    """``(licence, text)`` of the short licences that come with the operator; callers may give more."""
    return _rows(spark, forms(), "text")


def known_digests(spark: SparkSession) -> DataFrame:
    """``(licence, known_sha256)`` of the long licences that come with the operator as digests only."""
    return _rows(spark, [(name, digest) for name, digests in DIGESTS.items() for digest in digests], "known_sha256")


def licence_scan(docs: DataFrame, licences: DataFrame | None = None, digests: DataFrame | None = None) -> DataFrame:
    """``(doc_id, licence, canonical_sha256)``, one row per row of ``docs``; a null licence where none is known.

    Known are the texts of ``licences`` and the canonical digests of ``digests``; without both, those that come with
    the operator. Of licences with one canonical form the first name is given. Null texts count as empty; a text
    without letters or digits is no licence. Ids may be null or repeat. Other columns are ignored.
    """
    if licences is None and digests is None:
        licences, digests = known_licences(docs.sparkSession), known_digests(docs.sparkSession)
    form = canonical(F.col("text"))
    known = digests.select("licence", "known_sha256") if digests is not None else None
    if licences is not None:
        texts = licences.select("licence", form.alias("form")).where("form <> ''").select(
            "licence", F.sha2(F.col("form").cast("binary"), 256).alias("known_sha256"))
        known = texts if known is None else texts.unionByName(known)
    known = known.groupBy("known_sha256").agg(F.min("licence").alias("licence"))
    mine = docs.select("doc_id", F.sha2(form.cast("binary"), 256).alias("canonical_sha256"))
    return mine.join(known, F.col("canonical_sha256") == F.col("known_sha256"), "left").select(
        "doc_id", "licence", "canonical_sha256")

"""From raw documents to packed training sequences: five stages, each written and read again."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.llm.decontaminate import without_leaks
from recordmill.llm.exact_dedup import exact_groups
from recordmill.llm.packing import packed
from recordmill.llm.queries import tokenizer_path
from recordmill.llm.simhash import near_duplicates
from recordmill.llm.text import digest, keep_one_each, read_texts
from recordmill.llm.toxicity import fit, held_out, score
from recordmill.plans.pins import pin

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under one half. The classifier learns from the labels of these documents."""
    labels = read_texts(spark, f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    name = "score" + "_" * max(map(len, docs.columns))  # longer than the documents' own columns
    return score(docs, model, name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to A-Z) the document with the largest id."""
    return keep_one_each(docs, exact_groups(docs).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash the document with the smallest id (and then digest)."""
    keyed = docs.select(F.struct(F.col("doc_id"), digest(F.col("text")).alias("text_sha256")).alias("doc"), "text")
    groups = near_duplicates(keyed, id_column="doc")
    return keep_one_each(docs, groups.select("component_id.*").distinct())


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_leaks(docs, read_texts(spark, f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of token sequences."""
    return packed(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]

#: Training of the classifier and packing are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; each reads what the former wrote to the shared folder."""
    docs = read_texts(spark, f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir))
    return docs

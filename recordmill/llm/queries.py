"""The registered queries: each operator over its whole table, with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordmill.llm.decontaminate import contaminated
from recordmill.llm.divergence import divergence
from recordmill.llm.embedding_dedup import near_vectors
from recordmill.llm.exact_dedup import exact_groups
from recordmill.llm.language_model import scored
from recordmill.llm.licence_scan import licence_scan
from recordmill.llm.oracle import SQL  # noqa: F401
from recordmill.llm.packing import packed
from recordmill.llm.personal_data import personal_data
from recordmill.llm.simhash import near_duplicates
from recordmill.llm.text import read_texts
from recordmill.llm.toxicity import toxicity
from recordmill.llm.url_filter import judged
from recordmill.llm.warc import archived
from recordmill.llm.word_runs import digests, with_periodic_tails, word_runs


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_texts(spark, f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licence_scan(_table(spark, folder, "documents"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(_table(spark, folder, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(_table(spark, folder, "documents"), tokenizer_path())


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archived(_table(spark, folder, "pages")).drop("payload")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(_table(spark, folder, "documents"))


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return scored(_table(spark, folder, "documents"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judged(_table(spark, folder, "pages"))


def op11_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    return digests(word_runs(with_periodic_tails(_table(spark, folder, "documents"))))


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence(_table(spark, folder, "documents"))


def op13_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_decontaminate, op3_licences, op4_exact_dedup, op5_packing, op6_warc, op7_toxicity,
              op8_personal_data, op9_lm_scoring, op10_url_filter, op11_word_runs,
              op12_divergence, op13_embedding_dedup)
}

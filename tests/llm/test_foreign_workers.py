"""Executors without a copy of the package; documents whose columns are named as the operators name theirs."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpus_pipeline import drop_copies, drop_leaks, drop_near_copies, drop_toxic
from recordmill.llm import language_model, personal_data, toxicity

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()


@pytest.fixture(scope="module")
def values(spark):
    docs = spark.createDataFrame([(k, " ".join(WORDS[k % 5 :]) + f" call +49 (0) 30 12345{k:02} or a{k}@b.example") for k in range(40)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    return {"toxicity": toxicity.fit(docs, labels, F.lit(True)), "personal_data": personal_data.fit(docs)}


@pytest.mark.parametrize("name", ["toxicity", "personal_data"])
def test_models_are_read_where_the_package_is_not(values, name, tmp_path):
    code = "import pickle, sys; v = pickle.loads(sys.stdin.buffer.read()); assert 'recordmill' not in sys.modules; print(type(v).__name__)"
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(values[name]), capture_output=True, cwd=tmp_path, env=clean)
    assert done.returncode == 0, done.stderr.decode()
    assert done.stdout.decode().strip() == type(values[name]).__name__


def test_vocabularies_are_read_too(tmp_path):
    kinds = [v for v in vars(language_model).values() if isinstance(v, type) and v.__module__ == language_model.__name__]
    assert kinds
    code = "import pickle, sys; pickle.loads(sys.stdin.buffer.read()); assert 'recordmill' not in sys.modules"
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps((kinds, np.zeros(2))), capture_output=True, cwd=tmp_path, env=clean)
    assert done.returncode == 0, done.stderr.decode()


def test_columns_named_as_the_operators_name_theirs(spark, tmp_path):
    names = ["toxic", "labelled", "leaked", "_id", "_digest", "toxicity_score", "doc", "row", "component_id", "words", "n"]
    text = " ".join(WORDS)
    rows = [(1, text), (2, text.upper()), (3, text + " and more"), (4, None), (5, "quite another text"), (5, "quite another text")]
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(n + " "), F.col("doc_id").cast("string")).alias(n) for n in names])
    spark.createDataFrame([(k, 1, 0) for k in range(1, 6)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "quite another text which no document holds whole at all")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    for stage in (drop_toxic, drop_copies, drop_near_copies, drop_leaks):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        found = got.collect()
        assert found and all(r[n] == f"{n} {r.doc_id}" for r in found for n in names)
    scored = toxicity.toxicity(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert scored.count() == len(rows)

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordmill.llm.simhash import fingerprint
from tests.llm.test_decontaminate import leaks
from tests.llm.test_exact_dedup import lowered
from tests.llm.test_packing import check
from tests.llm.test_simhash import components_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def corpus():
    rng = random.Random(21)
    words = [f"w{k}" for k in range(900)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([5, 60, 150])))) for k in range(160)]
    rows += [(200 + k, rows[k][1].upper()) for k in range(12)]  # copies up to A-Z
    for k in range(20):  # near copies
        near = rows[20 + k][1].split()
        near[rng.randrange(len(near))] = "changed"
        rows.append((300 + k, " ".join(near)))
    items = [(k, " ".join(rng.choice(words) for _ in range(20))) for k in range(4)]
    rows += [(400 + k, f"{rows[60 + k][1]} {items[k % 4][1]} and more") for k in range(8)]
    rows += [(500 + k, f"{rows[90 + k][1]} vileword") for k in range(60)]
    rows += [(None, "no id"), (None, "No id"), (None, None), (600, ""), (3, rows[3][1]), (3, "another text of that id")]
    labels = [(i, 1, int("vileword" in (t or ""))) for i, t in rows if i is not None and i % 7]
    return rows, items, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items, labels = corpus()
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "clash") for i, t in rows], SCHEMA).write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_each_stage_on_its_own_input(spark, folder, tmp_path):
    _, items, _ = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            check(before, docs.collect(), 2048)
            continue
        after = [(r.doc_id, r.text) for r in docs.collect()]
        assert docs.columns == columns and set(after) <= set(before)
        if name == "toxicity":
            gone = set(before) - set(after)
            assert all("vileword" in t for _, t in gone) and len(gone) > 50
        elif name == "exact_dedup":
            best = {}
            for i, t in before:
                best[lowered(t)] = max(best.get(lowered(t), -1), -1 if i is None else i)
            assert sorted((lowered(t), -1 if i is None else i) for i, t in after) == sorted(best.items())
        elif name == "simhash":
            group = components_of(range(len(before)), [fingerprint(t) for _, t in before], 4)
            assert len(after) == len(set(group.values()))
            kept = {group[before.index(row)] for row in after}
            assert kept == set(group.values())
        else:
            assert sorted(map(repr, after)) == sorted(repr(r) for r in before if not leaks(r[1], items))


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

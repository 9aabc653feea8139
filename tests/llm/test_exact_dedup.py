import hashlib
import random

import pytest
from pyspark.sql import functions as F

from recordmill.llm.exact_dedup import chunks, exact_groups
from recordmill.llm.text import ascii_lower, digest, keep_one_each


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(
        (repr(i), repr(largest[lowered(t)]), len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest())
        for i, t in rows)


def sample():
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "De", "Ünïcode", "ÄB", "the\n", "b", "x" * 400]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 900, 4000]))) for _ in range(25)]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(100 + k, texts[k % 5].upper() if k % 2 and texts[k % 5].isascii() else texts[k % 5]) for k in range(20)]
    # the same text but for one chunk in the middle, or two chunks exchanged
    rows += [(200, texts[0] + "Z"), (201, "Z" + texts[0]), (202, texts[3] + texts[4]), (203, texts[4] + texts[3])]
    return rows + [(None, ""), (300, None), (301, ""), (301, "")]


@pytest.mark.parametrize("identifier", [None, lambda c: F.pmod(F.xxhash64(c), F.lit(3)),
                                        lambda c: F.lit(7).cast("long") + F.length(c) * 0])
def test_groups_are_exact_whatever_the_identifier(documents, identifier):
    rows = sample()
    found = exact_groups(documents(rows), **({"identifier": identifier} if identifier else {})).collect()
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in found) == expected(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_chunks_are_whole_and_follow_the_content(spark):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(1, 8))) for _ in range(9000))
    rows = spark.createDataFrame([(text,), ("a few new words " + text,), ("x" * 20_000,), ("",)], "t string")
    cut = [r.c for r in rows.select(chunks(F.col("t")).alias("c")).collect()]
    assert ["".join(c) for c in cut] == [text, "a few new words " + text, "x" * 20_000, ""]
    assert len(set(cut[0]) & set(cut[1])) > 0.8 * len(cut[0])


def test_odd_and_empty(odd_documents, no_documents):
    rows = exact_groups(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    one = [r for r in rows if r.text_sha256 == hashlib.sha256(b"one").hexdigest()]
    assert [r.kept for r in one].count(True) == 1 and {r.keep_id for r in one} == {3}
    assert exact_groups(no_documents).collect() == []


def test_kept_rows_with_repeated_and_missing_ids(odd_documents):
    kept = exact_groups(odd_documents).where("kept")
    rows = keep_one_each(odd_documents, kept)
    assert rows.columns == odd_documents.columns
    got = rows.select(digest(F.col("text")).alias("d")).collect()
    assert len(got) == len({r.d for r in got}) == kept.count()


def test_lower_case_of_a_to_z_only(spark):
    row = spark.createDataFrame([("AZ az ÄÉİ ẞ",)], "t string").select(ascii_lower(F.col("t")).alias("t")).first()
    assert row.t == "az az ÄÉİ ẞ"

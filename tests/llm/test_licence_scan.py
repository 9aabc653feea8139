import os

import pytest
from pyspark.sql import functions as F

from recordmill.llm.licence_scan import canonical, forms, known_digests, known_licences, licence_scan
from recordmill.llm.licence_texts import DIGESTS, LICENCES, TITLES

PUBLISHED = "/usr/share/common-licenses"  # whole texts, where the system has them
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3",
         "MPL-2.0": "MPL-2.0"}


def test_variants_of_known_texts(documents):
    mit = LICENCES["MIT"]
    own = mit.replace("Copyright (c) <year> <copyright holders>", "Copyright (c) 2019 A. Person\n * Copyright 2020-2021 B")
    rows = [(1, mit), (2, own), (3, own.upper()), (4, mit.replace(" ", "\n  ")), (5, mit.replace("sublicense", "sub-licence")),
            (6, mit + " And more."), (7, LICENCES["ISC"].replace("\n", " # ")), (8, LICENCES["BSD-3-Clause"].replace('"', "“"))]
    rows += [(20 + k, t) for k, t in enumerate(LICENCES.values())]
    found = {r.doc_id: r.licence for r in licence_scan(documents(rows)).collect()}
    # white space in place of the blank after a copyright sign keeps the line a copyright line or drops it
    assert [found[k] for k in (1, 2, 3, 5, 6)] == ["MIT", "MIT", "MIT", "MIT", None]
    assert found[8] == "BSD-3-Clause" and [found[20 + k] for k in range(len(LICENCES))] == list(LICENCES)


def test_titles_and_reserved_rights(documents):
    texts = [(name, text) for name, text in forms()]
    assert len(texts) == len(LICENCES) + sum(map(len, TITLES.values()))
    texts += [("BSD-3-Clause", "BSD 3-CLAUSE LICENCE\n\nCopyright 2011, Some One.\nAll rights reserved.\n" + LICENCES["BSD-3-Clause"])]
    texts += [(None, "MIT License"), (None, "Apache License\n" + LICENCES["MIT"])]
    found = {r.doc_id: r.licence for r in licence_scan(documents([(k, t) for k, (_, t) in enumerate(texts)])).collect()}
    assert [found[k] for k in range(len(texts))] == [name for name, _ in texts]


@pytest.mark.skipif(not os.path.isdir(PUBLISHED), reason="no published texts on this system")
def test_long_licences_by_their_digest(documents):
    rows, want = [], []
    for name, file in FILES.items():
        with open(f"{PUBLISHED}/{file}", encoding="utf-8") as text:
            whole = text.read()
        for form in [whole, whole.upper(), " ".join(whole.split(" ")).replace(",", " ;"), whole + " More.", whole[1000:]]:
            rows.append((len(rows), form))
        want += [name, name, name, None, None]
    found = {r.doc_id: r.licence for r in licence_scan(documents(rows)).collect()}
    assert [found[k] for k in range(len(rows))] == want


def test_given_digests_alone(spark, documents):
    given = spark.createDataFrame([("own", "2c26b46b68ffc68ff99b453c1d30413413422d706483bfa0f98a5e886266e7ae")],
                                  "licence string, known_sha256 string")
    found = {r.doc_id: r.licence for r in licence_scan(documents([(1, "Foo!"), (2, LICENCES["MIT"])]), digests=given).collect()}
    assert found == {1: "own", 2: None}
    assert known_digests(spark).count() == sum(map(len, DIGESTS.values()))


def test_copyright_lines_only(spark):
    texts = ["Copyright (c) 2020 X\nkept", "// copyright 2001 y\nkept", "copyright notice kept", "a (c) kept", "  © X\nkept",
             "Favour https: & LICENCE", "", None, "!!", "x\n# All Rights Reserved.\ny", "all rights reserved by z"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.c for r in frame.select("k", canonical(F.col("t")).alias("c")).orderBy("k").collect()]
    assert got == ["kept", "kept", "copyright notice kept", "a c kept", "kept", "favor http and license", "", "", "", "x y",
                   "all rights reserved by z"]


def test_odd_and_empty(spark, odd_documents, no_documents):
    rows = licence_scan(odd_documents).collect()
    assert len(rows) == odd_documents.count() and {r.licence for r in rows} == {None}
    assert licence_scan(no_documents).collect() == []
    none = known_licences(spark).where("false")
    assert licence_scan(odd_documents, none).count() == len(rows)
    same = spark.createDataFrame([("b", "ONE!"), ("a", "one"), ("c", None)], "licence string, text string")
    assert sorted(r.doc_id or 0 for r in licence_scan(odd_documents, same).where("licence = 'a'").collect()) == [0, 3, 3]

import random
import re
from collections import Counter

import numpy as np
import pytest

from recordmill.llm.divergence import Side, divergence, gallop, merged, share, shares, term_counts, terms_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def expected(rows, term_ranks=200):
    """The definition, term by term over the whole vocabulary."""
    counts, documents, langs = {}, {}, {}
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = words_of(text)
        counts.setdefault((lang, source), Counter()).update(found)
        langs.setdefault(lang, Counter()).update(found)
        documents.setdefault(lang, Counter()).update(set(found))
    out = []
    for lang, all_counts in langs.items():
        kept = sorted(t for t, k in documents[lang].items() if k >= 3)

        def portions(c, kept=kept):
            whole = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // whole for t in kept}

        p = {s: portions(c) for (own, s), c in counts.items() if own == lang}
        q = portions(all_counts)
        for s in p:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in p if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                found = found[:term_ranks] if part == "term" else found
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found, 1)]
    return sorted(out)


def sample(n=120):
    rng = random.Random(12)
    stock = [f"{a}{b}" for a in "abcdeÉü日" for b in "klmnopqrstuv"]
    rows = []
    for k in range(n):
        source = rng.choice(["hot"] * 4 + ["s1", "s2", "s3", "s4", "S5", None])
        lang = rng.choice(["en"] * 4 + ["de", None])
        own = stock[: rng.choice([20, 60, 96])]
        text = ", ".join(rng.choice(own) + rng.choice(["", "", "7", "-X"]) for _ in range(rng.randint(0, 60)))
        rows.append((k, text, lang, source, 0))
    return [*rows, (1, "Én EN én en 12", "fr", "a", 0), (None, None, "fr", "b", 0), (5, "", "xx", "only", 0)]


@pytest.mark.parametrize("sizes", [(4096, 32), (7, 2)])
def test_as_defined(spark, sizes):
    rows = sample()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as kept", "text as term", "2 as value")
    found = divergence(docs, shard_terms=sizes[0], block_sources=sizes[1])
    assert sorted(tuple(r) for r in found.collect()) == expected(rows)


def test_ranks_end_where_asked(spark):
    rows = sample(60)
    found = divergence(spark.createDataFrame(rows, SCHEMA), term_ranks=3, shard_terms=10)
    assert sorted(tuple(r) for r in found.collect()) == expected(rows, term_ranks=3)


def test_counts_do_not_depend_on_when_tasks_send_them(spark):
    docs = spark.createDataFrame(sample(40), SCHEMA).na.fill("", ["lang", "source"])
    few, many = (sorted(map(tuple, term_counts(docs, held=h).collect())) for h in (5, 10**6))
    assert few == many and few


def test_galloping_finds_equal_ids():
    rng = np.random.default_rng(2)
    for _ in range(200):
        few, many = (np.unique(rng.integers(0, 900, rng.integers(0, 500))) for _ in range(2))
        i, j = gallop(few, many, stride=int(rng.integers(1, 70)))
        assert few[i].tolist() == many[j].tolist() == np.intersect1d(few, many).tolist()


def test_a_merge_prices_every_term_both_ways():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = (rng.integers(0, 4, 60) * rng.integers(0, 2, 60) for _ in range(2))
        sides = [Side(np.flatnonzero(n), n[n > 0], int(n.sum()), 60) for n in (a, b)]
        p, q = ([1 + 10**9 * (int(x) + 1) // (int(n.sum()) + 60) for x in n] for n in (a, b))
        assert merged(*sides, 60) == (sum((x - y) ** 2 // y for x, y in zip(p, q, strict=True)),
                                      sum((y - x) ** 2 // x for x, y in zip(p, q, strict=True)))


def test_shares_of_very_large_counts(spark):
    many = [0, 7, 10**10, 8 * 10**14]
    whole = 9 * 10**14 + 12_345
    exact = [1 + 10**9 * (n + 1) // whole for n in many]
    assert shares(np.array(many), whole).tolist() == exact
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(n,) for n in many], "n long").select(
        share(F.col("n"), F.lit(whole - 45), F.lit(45).cast("long")).alias("p"))
    assert sorted(r.p for r in rows.collect()) == exact


def test_terms():
    assert [t for t in terms_of("Ab1cD-É\x00x É_Z\t日本".encode()) if t] == [
        t.encode() for t in words_of("Ab1cD-É\x00x É_Z\t日本")]
    assert terms_of(None) == [] or terms_of(None) == [b""]


def test_odd_and_empty(odd_documents, no_documents):
    assert divergence(no_documents).collect() == []
    assert {r.part for r in divergence(odd_documents).collect()} <= {"pair", "term"}

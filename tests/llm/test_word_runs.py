import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from recordmill.llm.word_runs import digests, lyndon_lengths, runs_of, with_periodic_tails, word_runs


def lyndon_by_definition(letters):
    """A word is a Lyndon word if it is smaller than each of its proper endings."""
    n = len(letters)
    return [max(k for k in range(1, n - i + 1)
                if all(letters[i : i + k] < letters[i + j : i + k] for j in range(1, k))) for i in range(n)]


def runs_by_definition(words, least=12):
    """Stretches in which words a period apart are equal, as long as they get; the smallest period of each."""
    found = {}
    for period in range(1, len(words) // 2 + 1):
        i = 0
        while i + period < len(words):
            j = i
            while j + period < len(words) and words[j] == words[j + period]:
                j += 1
            if j > i and j - i >= period and j - i + period >= least:
                found.setdefault((i, j - i + period), period)
            i = max(j, i + 1)
    return sorted((start, length, period) for (start, length), period in found.items())


def letters_of(rng, n, kinds):
    drawn = [rng.randrange(kinds) for _ in range(n)]
    if rng.random() < 0.5:
        start = rng.randrange(n)
        period = rng.randint(1, max(1, (n - start) // 2))
        drawn = drawn[:start] + [drawn[start + i % period] for i in range(n - start)]
    rank = {x: k for k, x in enumerate(sorted(set(drawn)))}
    return [rank[x] for x in drawn]


def test_grouping_gives_lyndon_lengths_under_both_orders():
    rng = random.Random(3)
    for _ in range(800):
        letters = letters_of(rng, rng.randint(1, 25), rng.randint(1, 4))
        top = max(letters)
        assert lyndon_lengths(letters) == lyndon_by_definition(letters)
        assert lyndon_lengths(letters, inverse=True) == lyndon_by_definition([top - x for x in letters])


@pytest.mark.parametrize("least", [2, 12])
def test_runs_are_those_of_the_definition(least):
    rng = random.Random(5)
    for _ in range(800):
        letters = letters_of(rng, rng.randint(1, 90), rng.randint(1, 6))
        assert [tuple(r) for r in runs_of(np.array(letters), least).tolist()] == runs_by_definition(letters, least)
    assert runs_of(np.zeros(0, np.int64)).tolist() == []
    assert runs_of(np.zeros(50_000, np.int64)).tolist() == [[0, 50_000, 1]]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def sample():
    rng = random.Random(8)
    stock = ["alpha", "Beta", "beta", "ünï", "日本", "x"] + [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(stock[: rng.choice([3, 6, 300])]) for _ in range(rng.choice([5, 30, 200])))
             for _ in range(60)]
    line = "a line that the page repeats in full,\n"
    return [*texts, line * 40, "before it " + line * 3 + "and behind", " ".join(fibonacci(700)), "no " * 11, "no " * 12,
            "no  no  \t" * 9, "", None, " \n", "one"]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    crc = zlib.crc32(str(doc_id).encode())
    n, g = len(words), crc // 10
    if doc_id is not None and crc % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_definition(words)
    dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    s, k, q = best or (None, None, None)
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), s, k, q, best and 1000 * k // q,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_whole_documents_against_the_definition(documents):
    rows = [(k * 7, t) for k, t in enumerate(sample() * 3)] + [(None, "ha " * 30), (3, "ha " * 30), (3, "ha " * 30)]
    got = digests(word_runs(with_periodic_tails(documents(rows)))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(i, t) for i, t in rows), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
    assert sum(r.n_runs > 0 for r in got) > 20


def test_spans_and_texts(documents):
    row = word_runs(documents([(1, "x " + "a b c " * 5 + "a y")])).first()
    assert [tuple(r) for r in row.runs] == [(1, 16, 3)]
    assert row.collapsed == "x a b c y" and row.n_words == 18


def test_odd_and_empty(odd_documents, no_documents):
    rows = word_runs(odd_documents).collect()
    assert len(rows) == odd_documents.count() and all(r.collapsed is not None for r in rows)
    assert digests(word_runs(with_periodic_tails(odd_documents))).count() == odd_documents.count()
    assert word_runs(no_documents).collect() == []


def test_columns_of_other_names_stay(documents):
    docs = documents([(1, "a"), (10, "b c d")]).selectExpr("*", "lang as tail", "doc_id as doc")
    made = with_periodic_tails(docs)
    assert made.columns == docs.columns
    assert [(r.tail, r.doc) for r in made.orderBy("doc_id").collect()] == [("en", 1), ("en", 10)]

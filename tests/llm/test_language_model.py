import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from recordmill.llm import language_model as L
from recordmill.llm.words import spaced_words


def texts(n, seed):
    """Alternating words, so that what comes before tells what comes next; one rare word now and then."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = []
        for _ in range(rng.randint(0, 40)):
            words += [rng.choice(["Ada", "bob", "cid"]), rng.choice(["runs", "sits"])]
            if rng.random() < 0.1:
                words.append(f"rare{rng.randrange(3000)}")
        out.append((k, " ".join(words)))
    return out


@pytest.mark.parametrize(("known", "classes"), [(1 << 19, 1000), (8, 4), (1, 1)])
def test_base_score_as_by_counting(documents, known, classes):
    rows = texts(150, 13) + [(500, None), (None, "lone text"), (7, "Ada ada"), (7, "Ada ada"), (501, "never seen before")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {k: [*spaced_words(t), b" "] for k, (_, t) in enumerate(rows)}
    c = Counter(x for k, (i, _) in enumerate(rows) if not held(i) for x in tokens[k])
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), held(i), len(tokens[k]), sum(x in c for x in tokens[k]), n,
                   round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens[k]), 6)) for k, (i, _) in enumerate(rows))
    found = L.scored(documents(rows), known, classes).collect()
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                  for r in found) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_tables_are_normalised():
    model = L.LogBilinear(30, np.log(np.full(30, 1 / 30)))
    model.output *= 20
    near, far, norm = model.tables()
    for a, b in [(0, 1), (30, 30), (5, 30), (29, 0)]:
        assert abs(np.exp(near[a] + far[b] - norm[a, b]).sum() - 1) < 1e-4


def test_members_of_classes_sum_to_one(spark):
    counts = spark.createDataFrame([(bytearray(L.END), 5), *[(bytearray(f"w{k}".encode()), k + 1) for k in range(50)]],
                                   "token binary, c long")
    v = L.vocabulary(counts, known=1 << 19, word_classes=10)
    assert v.tokens == 5 + 50 * 51 // 2 and v.distinct == 51 and v.class_counts.sum() == v.tokens
    mass = np.zeros(L.BUCKETS)
    for token, at in v.known.items():
        if v.classes[at] >= v.first_bucket:
            b = v.classes[at] - v.first_bucket
            assert b == L.bucket_of(token)
            mass[b] += (v.counts[at] + 1) / v.bucket_sizes[b]
    assert np.allclose(mass + 1 / v.bucket_sizes, 1)  # and one member for all that was never seen


def test_step_follows_the_gradient():
    model = L.LogBilinear(12, np.log(np.full(12, 1 / 12)), dim=5)
    rng = np.random.default_rng(1)
    word, before, noise = rng.integers(0, 12, 64), rng.integers(0, 13, (64, 2)), rng.integers(0, 12, 6)
    log_noise = np.log(np.full(12, 0.5)).astype(np.float32)

    def likelihood():
        hidden = model.context[before[:, 0]] @ model.turn[0] + model.context[before[:, 1]] @ model.turn[1]
        right = (hidden * model.output[word]).sum(1) + model.bias[word] - log_noise[word]
        wrong = hidden @ model.output[noise].T + model.bias[noise] - log_noise[noise]
        return float(-np.log1p(np.exp(-right)).sum() - np.log1p(np.exp(wrong)).sum())

    rates = [np.full_like(p, 1e4) for p in model.parts()]  # hardly adaptive: a plain small step
    start, flat = likelihood(), model.flat()
    model.learn(word, before, rates, noise, log_noise, 1e-3)
    moved = model.flat() - flat
    gain = likelihood() - start
    slope = float((moved / (1e-3 / 100)) @ moved)
    assert gain > 0 and abs(gain / slope - 1) < 0.05


def test_learns_order(documents):
    rows = texts(900, 14)
    found = L.scored(documents(rows), rounds=3).where("held_out").groupBy().sum("base_score", "score").first()
    assert found[1] > found[0] * 0.95


def test_odd_and_empty(odd_documents, no_documents):
    assert L.scored(odd_documents).count() == odd_documents.count()
    assert L.scored(no_documents).collect() == []
    only_held = odd_documents.selectExpr("2L as doc_id", "text")  # crc32('2') mod 7 is 2 or not; either way it works
    assert L.scored(only_held).count() == odd_documents.count()

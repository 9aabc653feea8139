import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from recordmill.llm.components import connected_components
from recordmill.llm.simhash import fingerprint, fingerprint_links, linked_pairs, near_duplicates, position_triples


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    votes = Counter(bit for s in shingles for bit in range(64) if xxhash.xxh64_intdigest(s, 42) >> bit & 1)
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(shingles))


def components_of(ids, prints, bits):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    groups = {}
    for k, i in enumerate(ids):
        groups.setdefault(find(k), []).append(i)
    return {k: min((i for i in groups[find(k)] if i is not None), default=None) for k in range(len(ids))}


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out).split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randint(1, 60))))
    return out


def test_every_four_positions_hold_a_triple():
    triples = [set(t) for t in position_triples()]
    assert len(triples) == 20
    from itertools import combinations
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_fingerprint_as_defined():
    for text in [None, "", " ", "One two", "a b c d", "A B c d e f g", "é É x y z w   q", *texts(40, 1)]:
        assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("block", [4096, 3])
def test_components_as_by_brute_force(documents, block):
    rows = [(k * 7 % 211, t) for k, t in enumerate(texts(200, 2))] + [(None, "a lone text"), (500, None)]
    got = near_duplicates(documents(rows), block=block).collect()
    want = components_of([i for i, _ in rows], [plain_fingerprint(t) for _, t in rows], 4)
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in got)
    assert found == sorted((i if i is not None else -1, f"{plain_fingerprint(t):016x}",
                            want[k]) for k, (i, t) in enumerate(rows))


@pytest.mark.parametrize(("block", "chunk"), [(4096, 1 << 18), (5, 16)])
def test_links_connect_close_fingerprints(spark, block, chunk):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(40):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            prints.add(int(b) ^ sum(1 << int(f) for f in flips))
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    roots = {r.node: r.root for r in connected_components(fingerprint_links(frame, 4, block, chunk)).collect()}
    want = components_of(list(range(len(prints))), prints, 4)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    for i in range(len(prints)):
        for j in range(i):
            same = roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j])
            assert same == (want[i] == want[j])


def test_pairs_need_the_guaranteed_matches():
    fp = np.array([0, 0b1111, 0b11111, 0xFF], np.uint64)
    left, right = linked_pairs(np.zeros(4, np.int64), fp, 4)
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == {(0, 1), (1, 2), (1, 3), (2, 3)}


def test_chain_of_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(5, 5), (None, 3), (100, 101), (101, 100)],
                                  "a long, b long")
    roots = {r.node: r.root for r in connected_components(links).collect()}
    assert roots == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_odd_and_empty(odd_documents, no_documents):
    rows = near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}
    assert near_duplicates(no_documents).collect() == []

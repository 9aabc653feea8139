import random

from recordmill.llm.decontaminate import (
    LEAST, MASKS, REACH, SIMILARITY, SPAN, contaminated, overlaps, seed_starts, substitutions, without_leaks,
)
from recordmill.llm.words import letter_words


def leaks(text, items):
    """By brute force: items that agree in enough words with the text, as a whole or in a window."""
    words, found = letter_words(text), set()
    for item, passage in items:
        other = letter_words(passage)
        if len(other) < LEAST:
            continue
        for span in {min(SPAN, len(other)), len(other)}:
            for i in range(len(words) - span + 1):
                for j in range(len(other) - span + 1):
                    if sum(a == b for a, b in zip(words[i : i + span], other[j : j + span])) >= SIMILARITY * span:
                        found.add(item)
    return found


def passage(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def sample():
    rng = random.Random(6)
    items = [(k, " ".join(passage(rng, n))) for k, n in enumerate([8, 9, 11, 12, 15, 20, 40, 5, 1, 0])]
    items += [(50, items[5][1]), (None, items[6][1]), (60, None)]
    rows = []
    for k in range(150):
        words = passage(rng, rng.randrange(0, 60))
        if k % 3:
            part = items[k % 7][1].split()
            for _ in range(rng.randrange(0, 5)):
                part[rng.randrange(len(part))] = f"s{rng.randrange(99)}"
            at = rng.randrange(len(words) + 1)
            words[at:at] = part[: rng.randrange(6, len(part) + 1)] if k % 2 else part
        rows.append((k, " ".join(w.upper() + "," if rng.random() < 0.2 else w for w in words)))
    return rows, items


def test_masks_tolerate_any_two_substitutions():
    for a in range(SPAN):
        for b in range(a):
            assert any(a % 4 not in m and b % 4 not in m for m in MASKS)


def test_seeds_leave_no_item_out():
    """Each length has windows or seeds enough that not all of them can hold three substitutions."""
    for size in range(SPAN + 1, 400):
        wrong, starts = substitutions(size), seed_starts(size)
        if not starts:
            assert size // SPAN * 3 > wrong
        else:
            assert starts[0] == 0 and starts[-1] == size - LEAST <= REACH
            apart = [b - a for a, b in zip(starts, starts[1:])]
            assert min(apart) >= LEAST or (size, starts) == (15, [0, 7])  # there three words cannot share one place
            assert len(starts) * 3 > wrong


def test_whole_items_with_a_fifth_substituted(spark, documents):
    """Every item of 8 to 48 words is found wherever its substitutions are, and none with one more in each window."""
    rng = random.Random(4)
    items, rows = [(k, " ".join(f"i{k}x{j}" for j in range(k))) for k in range(LEAST, 49)], []
    for size, text in items:
        for k in range(12):
            words = text.split()
            wrong = substitutions(size) + k % 3 // 2  # every third holds one too many
            middle = rng.randrange(size)
            near = sorted(range(size), key=lambda p: abs(p - middle))[:wrong]
            for p in near if k % 2 else rng.sample(range(size), wrong):
                words[p] = "other"
            rows.append((size * 100 + k, " ".join(passage(rng, k % 4) + words + passage(rng, k % 5))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id for r in contaminated(documents(rows), bench).collect()}
    assert found == {i for i, t in rows if leaks(t, items)}
    assert {i for i, _ in rows if i % 100 % 3 < 2} <= found


def test_as_by_brute_force(spark, documents):
    rows, items = sample()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bits in (25, 8):  # a bitmap that is nearly full changes nothing
        found = {r.doc_id: r for r in contaminated(documents(rows), bench).collect()} if bits == 25 else {
            r.doc_id: None for r in overlaps(documents(rows), bench, bits).select("doc_id").distinct().collect()}
        want = {i: leaks(t, items) for i, t in rows}
        assert set(found) == {i for i, w in want.items() if w}
        if bits == 25:
            assert all(found[i].item_id == min(x for x in w if x is not None) for i, w in want.items() if w - {None})
    kept = without_leaks(documents(rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w}
    assert kept.columns == documents(rows).columns


def test_odd_and_empty(spark, odd_documents, no_documents):
    bench = spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(29_990, 30_000)))], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.doc_id for r in contaminated(odd_documents, bench).collect()} == {4, 5}
    assert without_leaks(odd_documents, none).count() == odd_documents.count()
    assert contaminated(no_documents, bench).collect() == []

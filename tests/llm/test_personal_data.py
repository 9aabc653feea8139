import hashlib
import itertools
import time

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from recordmill.llm.personal_data import (CARD, EMAIL, IP, KINDS, PHONE, REACH, Field, added_spans, base_spans,
                                          best_segments, candidates, disguises, examples, islands, joined, luhn,
                                          marginals, personal_data, train)

TEXTS = [
    "mail a.b+c@x-y.example.com, or d@e.f@g.h and @ alone@ x@y",
    "at 10.0.0.1 and 256.1.1.1 or 1.2.3.4.5.6.7.8 v1.2.3",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 and 4111111111111111 12345678901234567890",
    "call +1 (563) 555-5874 or +49.30.123456 and +12 or +1 (22) 333 4444 55555 66666",
    "a@b.c@d.e f@@g.h i@j..k.l @m.n o@p. q%+@-.r-s, t@u.v@w x@y.z.", "1..2.3.4.5 .6.7.8.9 10.11.12.13.14.15.16.17",
    "", "no digits at all", "é@ü.de ñ@x.y 日本 1.1.1.1\u2003+1 555 555 5555", "0000.0255.00001.9 x", "5" * 5000,
]


def plain(text):
    found = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    number = lambda m: "".join(filter(str.isdigit, m[0]))
    found += [(m.start(), m.end(), 2) for m in CARD.finditer(text) if 14 <= len(number(m)) <= 19 and luhn(number(m))]
    found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(number(m)) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_base_spans_as_by_the_patterns_alone():
    for text in TEXTS:
        assert base_spans(text) == plain(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+1 9(25é", max_size=40))
def test_base_spans_of_any_text(text):
    assert base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    start = time.process_time()
    for text in ["1" * 1_000_000, "x@" + "a" * 1_000_000, "1." * 500_000, "a@" * 500_000, "+1" * 500_000, "1 " * 500_000]:
        base_spans(text)
    assert time.process_time() - start < 15
    units = [(0, 500_000), (500_001, 500_002), (500_002, 900_000)]
    assert candidates("1" * 500_000 + " ." + "1" * 399_998, units)[0] == []
    assert candidates("1" * (REACH - 1) + ".", [(0, REACH - 1), (REACH - 1, REACH)])[0] == [(0, 1), (0, 2)]


def test_program_against_all_segmentations():
    rng = np.random.default_rng(12)
    n, moves = 4, rng.normal(size=2)
    grid = np.full((n, 16, len(KINDS)), -np.inf)
    for i in range(n):
        for d in range(min(3, n - i)):
            grid[i, d] = rng.normal(size=len(KINDS)) * 2
    totals = {}

    def walk(i, path, score, after):
        if i == n:
            totals[tuple(path)] = score
            return
        walk(i + 1, path, score + (moves[1] if after else 0), False)
        for d, k in itertools.product(range(min(3, n - i)), range(len(KINDS))):
            walk(i + d + 1, [*path, (i, i + d + 1, k)], score + grid[i, d, k] + (moves[0] if after else 0), True)

    walk(0, [], 0.0, False)
    chance, used, norm = marginals(grid, moves)
    weights = {p: np.exp(s - norm) for p, s in totals.items()}
    assert abs(sum(weights.values()) - 1) < 1e-9
    for i, d, k in itertools.product(range(n), range(3), range(len(KINDS))):
        if i + d < n:
            want = sum(w for p, w in weights.items() if (i, i + d + 1, k) in p)
            assert abs(chance[i, d, k] - want) < 1e-9
    joins = sum(w * sum(a[1] == b[0] for a, b in itertools.pairwise(p)) for p, w in weights.items())
    ends = sum(w * sum(x[1] < n and all(x[1] != y[0] for y in p) for x in p) for p, w in weights.items())
    assert abs(used[0] - joins) < 1e-9 and abs(used[1] - ends) < 1e-9
    assert tuple(best_segments(grid, moves)) == max(totals, key=totals.get)


def corpus(n):
    out = []
    for k in range(n):
        out += [f"word mail{k}.x@site{k % 9}.example.com and", f"from 10.{k % 250}.3.{k % 99} to", f"in {1900 + k} or {k} pieces",
                f"phone +1 ({200 + k}) 555-{1000 + k * 7} now", f"mail {'abcdefgh'[k % 8:]}@{'mnop'[k % 4:]}.org or", f"card {4111111111111111 if k % 2 else 5500005555555559} ok",
                f"ratio {k}.{k % 10} at 10:{k % 60} id {k * 977}"]
    return out


def test_field_adds_disguised_entities_only():
    model = train([e for t in corpus(60) for e in examples(t)], epochs=4)
    text = "call (563) 555-5874 now"
    assert [(KINDS[k], text[s:e]) for s, e, k in added_spans(text, model, base_spans(text))] == [("phone", "(563) 555-5874")]
    for text in ["built in 1987 with 350 pieces", "ratio 3.1 at 10:45", "nothing here", ""]:
        assert added_spans(text, model, base_spans(text)) == []
    text = " 77 ".join(["x"] * 3000) + " (563) 555-5874 y"
    assert ("phone", len(text) - 16, len(text) - 2) in [(KINDS[k], s, e) for s, e, k in added_spans(text, model, [])]


def test_field_finds_every_disguise_it_is_trained_on():
    model = train([e for t in corpus(120) for e in examples(t)])
    for entity, kind in [("jane.doe@mill.example.org", 0), ("10.20.30.40", 1), ("4111111111111111", 2), ("+1 (563) 555-5874", 3)]:
        for way in disguises(entity, kind):
            text = f"word {way} and"
            found = {(k, text[s:e]) for s, e, k in added_spans(text, model, base_spans(text))}
            assert (kind, way) in found, way
    for text in ["meet (at) noon", "look [at] this", "write to Jane [at] work"]:
        assert added_spans(text, model, []) == []
    text = "write to jane [at] example.com now, or joe(at)example.org"
    assert [text[s:e] for s, e, _ in added_spans(text, model, [])] == ["jane [at] example.com", "joe(at)example.org"]


def test_islands_cover_every_signal():
    for text in TEXTS:
        inside = set(itertools.chain.from_iterable(range(a, b) for a, b in islands(text)))
        assert all(k in inside for k, c in enumerate(text) if c in "0123456789@")


def test_query_rows(spark, documents, odd_documents, no_documents):
    rows = [(k % 20, t) for k, t in enumerate(TEXTS + corpus(8))] + [(None, None)]
    found = personal_data(documents(rows)).collect()
    want = sorted((repr(i), *(sum(k == kind for _, _, k in base_spans(t or "")) for kind in range(4)),
                   hashlib.sha256(joined(base_spans(t or "")).encode()).hexdigest()) for i, t in rows)
    assert sorted((repr(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found) == want
    by_digest = {r.base_sha256: set(filter(None, r.spans.split(","))) for r in found}
    for _, t in rows:
        base = joined(base_spans(t or ""))
        assert set(filter(None, base.split(","))) <= by_digest[hashlib.sha256(base.encode()).hexdigest()]
    assert personal_data(odd_documents).count() == odd_documents.count()
    assert personal_data(no_documents, Field()).collect() == personal_data(no_documents).collect() == []

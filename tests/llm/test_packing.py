import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recordmill.llm.packing import WordTokens, best_fit, packed, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=25))
def test_plans_place_every_piece_once(histogram):
    for make in (plan, best_fit):
        patterns = make(histogram, 40)
        placed = Counter()
        for content, many in patterns:
            assert many > 0 and 0 < sum(n * k for n, k in content.items()) <= 40
            for n, k in content.items():
                placed[n] += k * many
        assert placed == Counter({n: k for n, k in histogram.items()})


def test_exact_complements_are_used():
    # one, two and three pieces that fill a gap; best fit alone needs more sequences
    assert sum(m for _, m in plan({30: 10, 10: 10}, 40)) == 10
    assert sum(m for _, m in plan({26: 6, 9: 6, 5: 6}, 40)) == 6
    assert sum(m for _, m in plan({25: 4, 8: 4, 4: 4, 3: 4}, 40)) == 4
    assert sum(m for _, m in plan({20: 7}, 40)) == 4
    assert plan({}, 40) == []


@pytest.mark.parametrize("kind", ["any", "few", "short", "long"])
def test_never_more_sequences_than_best_fit_alone(kind):
    rng = np.random.default_rng(9)
    lengths = {"any": range(1, 2049), "few": range(1, 2049), "short": range(1, 400), "long": range(700, 2049)}[kind]
    most = {"any": 10**6, "few": 4, "short": 10**4, "long": 50}[kind]
    histogram = {n: int(k) for n, k in zip(lengths, rng.integers(0, most, len(lengths)), strict=True) if k}
    made, plain = (sum(m for _, m in how(histogram, 2048)) for how in (plan, best_fit))
    assert -(-sum(n * k for n, k in histogram.items()) // 2048) <= made <= plain


def test_words_are_forgotten_and_learnt_again():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdé") * rng.randint(1, 30) + rng.choice(["", ".", ","]) for _ in range(60)) for _ in range(20)]
    whole, small = WordTokens(PATH), WordTokens(PATH, most=10)
    for k in range(0, 20, 4):
        assert small.encode(texts[k : k + 4]) == whole.encode(texts[k : k + 4])
    assert len(small) < len(whole)


def test_capitals_do_not_make_special_tokens():
    texts = ["A <|ENDOFTEXT|> B", "x<|EndOfText|>", "THE End", "I\u0307 \u0130 K \u212a ΑΣ"]
    want = [np.array(e.ids, np.uint32).tobytes()
            for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert WordTokens(PATH).encode(texts) == want


def test_tokens_as_by_the_tokenizer():
    rng = random.Random(7)
    odd = ["don't", "we'll", "İstanbul", "ﬁ", "x<|endoftext|>y", "<|startoftext|>", "a\u0085d", "é", "12345", "!!??..",
           "​zero", "日本語", "😀😀", "a\x1db", "The", "the.", "word,", "क़लम", "'s", "ǅ", "\x00", "Ω", "a.b,c."]
    texts = [" ".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(80)] + ["", "  \n ", *odd]
    want = [np.array(e.ids, np.uint32).tobytes()
            for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    tokens = WordTokens(PATH)
    assert tokens.encode(texts) == want
    assert tokens.encode(texts) == want


def check(rows, found, capacity):
    ids = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        data = np.array([*ids.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for n, k in enumerate(range(0, len(data), capacity)):
            part = data[k : k + capacity]
            want[i, n, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence), -(-sum(r.length for r in found) // capacity)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packs_whole_documents(documents, capacity):
    rng = random.Random(8)
    words = ["the", "of", "Enßlich", "ñoción", "thble.", "and"]
    rows = [(k % 250, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 4, 4, 30])))) for k in range(300)]
    used, least = check(rows, packed(documents(rows), PATH, capacity).collect(), capacity)
    assert used <= 1.05 * least + 2


def test_odd_and_empty(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    check(rows, packed(odd_documents, PATH).collect(), 2048)
    assert packed(no_documents, PATH).collect() == []

"""Words of a text as 64-bit hashes, for the operators that work on arrays of words."""

import re

import numpy as np
import xxhash

CACHE_WORDS = 1 << 17


class WordHashes(dict):
    """XXH64 of byte strings, keeping the first ``CACHE_WORDS`` it meets; of bounded size."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, 7)
        if len(self) < CACHE_WORDS and len(word) < 64:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


LETTERS = re.compile(rb"[a-z0-9\x80-\xff]+")


def spaced_words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased, as UTF-8; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def letter_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return LETTERS.findall((text or "").encode("utf-8", "surrogatepass").lower())

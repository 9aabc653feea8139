"""Packing token sequences: exact complements first, best fit for the rest.

How pieces fill sequences depends only on how many there are of each length, and there are
at most ``capacity`` lengths. So the plan is made from that small table: from the longest
length down, a hashed index of single lengths, sums of two and sums of three tells which
lengths fill the gap exactly, and as many sequences are made at once as all counts allow.
What has no exact complement goes by best fit, again many equal sequences at a time.

Pieces are then numbered within their length, in slices, so that a length that very many
pieces have is not one task's work, and the number tells a piece its place.
"""

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordmill.plans.pins import pin

CAPACITY = 2048
CACHE_WORDS = 500_000
SLICE_ROWS = 1_000_000
END = b"\0\0\0\0"

Pattern = tuple[dict[int, int], int]  # {length: pieces of it}, number of such sequences


class WordTokens(dict):
    """Token ids of white-space separated words (bytes, A-Z lower-cased), as little-endian 32-bit integers.

    For byte-pair tokenizers that lower-case, drop white space, cut letters from other characters and mark
    the last token of each part with a suffix. What such a tokenizer makes of a word does not
    depend on its neighbours. Words met for the first time are encoded many at once: words of
    letters alone are one part each, so their tokens end at the suffix; the others are encoded
    one by one. Holds ``most`` words; beyond that only those of the texts at hand stay.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core already
        from tokenizers import Tokenizer

        self._most = most
        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        suffix = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self._last[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        self._added = [x.content.lower().encode() for x in self._tokenizer.get_added_tokens_decoder().values()]

    def _lowered(self, text: bytes) -> bytes:
        """A-Z in lower case, as the tokenizer would; not where that might make a special token of its own text."""
        lowered = text.lower()
        return text if any(token in lowered for token in self._added) else lowered

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        found = {}
        groups = [words[k : k + 100] for k in range(0, len(words), 100)]
        for group, ids in zip(groups, self._batch([" ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(self._last[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                raw, ends = ids.tobytes(), (ends * 4).tolist()
                found |= zip(group, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True)
            else:
                found |= zip(group, (x.tobytes() for x in self._batch(group)), strict=True)
        return found

    def _learn(self, words: set[bytes]) -> None:
        """Adds ``words``; a word that ends in a full stop or comma is its letters and that sign."""
        ended, letters, others = {}, set(), [".", ","]
        for word in words:
            text = word.decode("utf-8", "surrogatepass")
            if text[-1] in ".," and text[:-1].isalpha():
                ended[word] = text
                if word[:-1] not in self:
                    letters.add(text[:-1])
            elif text.isalpha():
                letters.add(text)
            else:
                others.append(text)
        found = dict(zip(others, (x.tobytes() for x in self._batch(others)), strict=True)) | self._letters(list(letters))
        self.update((text.encode("utf-8", "surrogatepass"), ids) for text, ids in found.items())
        self.update((word, self[word[:-1]] + found[text[-1]]) for word, text in ended.items())

    def encode(self, texts: list[bytes | str]) -> list[bytes]:
        raw = (t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts)
        split = [self._lowered(t).split() for t in raw]  # of bytes: ASCII white space only
        here = set().union(*split)
        new = here - self.keys()
        if len(self) + len(new) > self._most:
            stay = {word: self[word] for word in here - new}
            self.clear()
            self.update(stay)
        if new:
            self._learn(new)
        return [b"".join(map(self.__getitem__, words)) for words in split]


def word_tokens(path: str) -> WordTokens:
    """The words this worker process knows already, from earlier tasks too; kept with the module that tokenises."""
    import tokenizers

    held = vars(tokenizers).setdefault("_words_by_path", {})
    if path not in held:
        held.clear()
        held[path] = WordTokens(path)
    return held[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: documents as token ids and an end, cut after ``capacity``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        for part in parts:
            for k in range(0, part.num_rows, 512):
                some = part.slice(k, 512)
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(tokens.encode([t.as_py() or b"" for t in some.column(1)])):
                    ids += END
                    for j in range(0, len(ids), 4 * capacity):
                        cut = ids[j : j + 4 * capacity]
                        row.append(i)
                        piece.append(j // (4 * capacity))
                        start.append(j // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.col("text").cast("string").cast("binary")).mapInArrow(
        batches, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class ComplementIndex:
    """Which one, two or three of the lengths still available fill a gap exactly."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self._known: bytes | None = None

    def _refresh(self) -> None:
        there = self.counts > 0
        if (key := there.tobytes()) != self._known:
            self._known, self._there = key, there
            mask = int.from_bytes(np.packbits(there, bitorder="little").tobytes(), "little")
            sums = 0
            for a in np.flatnonzero(there).tolist():
                sums |= mask << a
            n = len(there)
            raw = (sums & ((1 << n) - 1)).to_bytes((n + 7) // 8, "little")
            self._pairs = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:n].astype(bool)

    def _fits(self, combination: tuple[int, ...]) -> bool:
        return all(self.counts[x] >= k for x, k in Counter(combination).items())

    def _two(self, total: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        low = (total + 1) // 2
        for a in (np.flatnonzero(self._there[low:total] & self._there[total - low : 0 : -1]) + low)[::-1].tolist():
            if self._fits((*used, a, total - a)):
                return (*used, a, total - a)
        return None

    def fill(self, length: int, gap: int, most: int = 3) -> tuple[int, ...] | None:
        """``length`` and up to ``most`` pieces that fill ``gap`` beside it, the longest first; None if nothing does."""
        self._refresh()
        if self._there[gap] and self._fits((length, gap)):
            return length, gap
        if most >= 2 and gap >= 2 and self._pairs[gap] and (found := self._two(gap, (length,))):
            return found
        if most >= 3 and gap >= 3:
            for a in (np.flatnonzero(self._there[1 : gap - 1] & self._pairs[gap - 1 : 1 : -1]) + 1)[::-1].tolist():
                if 3 * a < gap:
                    break
                if found := self._two(gap - a, (length, a)):
                    return found
        return None


def _filled(histogram: dict[int, int], capacity: int, sizes: list[int]) -> list[Pattern]:
    """Exact complements of up to ``sizes[k]`` pieces in round k, longest pieces first; best fit for what is left."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    patterns: list[Pattern] = []

    def take(combination: tuple[int, ...]) -> None:
        need = Counter(combination)
        many = int(min(counts[x] // k for x, k in need.items()))
        for x, k in need.items():
            counts[x] -= many * k
        patterns.append((dict(need), many))

    if counts[capacity]:
        take((capacity,))
    index = ComplementIndex(counts)
    for most in sizes:
        for length in range(capacity - 1, 0, -1):
            while counts[length] and (found := index.fill(length, capacity - length, most)):
                take(found)
    return patterns + best_fit({int(x): int(counts[x]) for x in np.flatnonzero(counts)}, capacity)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Sequences for pieces of the given lengths (1 to ``capacity``), as patterns and how often each is made.

    Complements of one, two and three pieces take from each other, and short pieces used up early leave long ones that
    pair badly. So the histogram is planned in several orders (all sizes at once, small sizes first, few sizes,
    none), and the plan with the fewest sequences counts.
    """
    orders = ([3], [1, 2, 3], [1, 2], [1], [])
    return min((_filled(histogram, capacity, sizes) for sizes in orders), key=lambda made: sum(many for _, many in made))


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best fit, longest first: a piece goes to the open sequence that it leaves the smallest gap in."""
    open_by_gap: dict[int, list[list]] = {}  # gap -> [[{length: pieces}, sequences], ...]

    def put(gap: int, content: dict[int, int], many: int) -> None:
        open_by_gap.setdefault(gap, []).append([content, many])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            gap = min((g for g in open_by_gap if g >= length), default=None)
            if gap is None:  # new sequences, each as full of this length as it gets
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, {length: each}, left // each)
                if left % each:
                    put(capacity - left % each * length, {length: left % each}, 1)
                break
            content, many = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                del open_by_gap[gap]
            each = gap // length
            full = min(many, left // each)
            if full:
                put(gap - each * length, content | {length: content.get(length, 0) + each}, full)
                left -= full * each
            rest = min(left, each) if many > full else 0
            if rest:
                put(gap - rest * length, content | {length: content.get(length, 0) + rest}, 1)
                left -= rest
            if many - full - (rest > 0):
                put(gap, content, many - full - (rest > 0))
    return [(content, many) for group in open_by_gap.values() for content, many in group]


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each pattern and length: which numbers of that length it takes, and where they go.

    Sorted by ``key``, length times 2**40 plus the first number; of each sequence's ``each`` pieces
    of the length the first lies at ``offset``.
    """
    taken: Counter = Counter()
    rows, sequence = [], 0
    for content, many in patterns:
        offset = 0
        for length in sorted(content, reverse=True):
            each = content[length]
            rows.append(((length << 40) + taken[length], taken[length], each, sequence, offset))
            taken[length] += each * many
            offset += each * length
        sequence += many
    rows.sort()
    return dict(zip(("key", "first", "each", "sequence", "offset"),
                    np.array(rows, np.int64).reshape(-1, 5).T.copy(), strict=True))


def numbered(rows: DataFrame, slices: int) -> DataFrame:
    """``rows`` and ``number``, from 0 within each ``length``; ``row`` tells rows apart."""
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = pin(
        sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
        .select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    within = Window.partitionBy("length", "slice").orderBy("row")
    return sliced.join(starts, ["length", "slice"]).withColumn(
        "number", F.col("before") + F.row_number().over(within) - 1).drop("slice", "before")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    A null text counts as empty and is a piece of one token, its end. Only documents longer than
    ``capacity`` are cut. Ids may be null or repeat; other columns are ignored. An empty table has no pieces.
    """
    spark = docs.sparkSession
    rows = pin(pieces(docs, tokenizer, capacity).withColumn("row", F.monotonically_increasing_id()))
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = spark.sparkContext.broadcast(places(plan(histogram, capacity)))  # bounded by the number of lengths
    # as many as the most frequent length needs
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), max(histogram.values(), default=0) // SLICE_ROWS + 1)
    wide = numbered(rows, slices).select("doc_id", "piece", "start", "length", "ids_crc32", "number")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for part in parts:
            length, number = (part.column(k).to_numpy() for k in (3, 5))
            at = np.searchsorted(place["key"], (length << 40) + number, side="right") - 1
            nth = number - place["first"][at]
            each = place["each"][at]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:5], pa.array(place["sequence"][at] + nth // each),
                 pa.array(place["offset"][at] + nth % each * length)],
                [*part.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return wide.mapInArrow(batches, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")

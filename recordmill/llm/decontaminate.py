"""Documents that hold passages of a benchmark, by spaced seeds.

A window is ``SPAN`` consecutive words of a benchmark item (the whole item where it is
shorter, down to ``LEAST`` words). Its positions fall into four classes by remainder; each
of six masks ignores two classes and hashes the words of the other two. If at most two
words of a window are substituted, some mask ignores both, so every document window
in which ``SIMILARITY`` of the words agree shares a hash with the benchmark's window.
Windows that share a hash are then compared word by word.

An item of some lengths (15 words, three of them substituted) can agree as a whole although no
window of it does. Such an item also has a few seeds of ``LEAST`` words, so many that one
of them holds at most two of its substitutions; around a seed's hit the whole item is compared.

A bitmap of fixed size, set from the benchmark's hashes, lets a task pass over nearly all
windows of its documents; the join decides on the rest. A fuller bitmap makes the join larger,
not the result different.
"""

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.words import WordHashes, letter_words
from recordmill.plans.pins import pin

SPAN = 12
LEAST = 8
SIMILARITY = 0.8
FILTER_BITS = 25
STEP = 1 << 14

_DRAWN = np.random.default_rng(20).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = list(combinations(range(4), 2))


def masked_hashes(words: np.ndarray, span: int) -> np.ndarray:
    """``(len(MASKS), windows)`` hashes of all windows of ``span`` words; none for a shorter text."""
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros((len(MASKS), 0), np.uint64)
    classes = [np.zeros(n, np.uint64) for _ in range(4)]
    for p in range(span):
        classes[p % 4] += words[p : p + n] * _DRAWN[p]
    found = np.stack([classes[a] + classes[b] for a, b in MASKS])
    found += (_DRAWN[40 : 40 + len(MASKS)] * np.uint64(span))[:, None]
    found ^= found >> np.uint64(31)
    found *= _DRAWN[50]
    return found ^ (found >> np.uint64(29))


def cells_of(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bitmap cells of each hash."""
    shift = np.uint64(64 - bits)
    return (hashes >> shift).astype(np.int64), ((hashes * _DRAWN[51]) >> shift).astype(np.int64)


def _is_set(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def substitutions(size: int) -> int:
    """Words of ``size`` that may differ."""
    return size - math.ceil(size * SIMILARITY)


def seed_starts(size: int) -> list[int]:
    """Where the seeds of an item of ``size`` words begin; none where its windows cannot miss it."""
    wrong = substitutions(size)
    if size <= SPAN or size // SPAN * 3 > wrong:
        return []
    count = wrong // 3 + 1  # two substitutions each are tolerated
    return [k * (size - LEAST) // (count - 1) for k in range(count)]


#: Words before and behind a seed that its item can cover. Four windows or more never miss an item.
REACH = max(starts[-1] for starts in map(seed_starts, range(4 * SPAN)) if starts)


def benchmark_windows(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """``(hash, span, start, other, item_id)``: each different masked window or seed once, with the smallest item.

    ``other`` are the words to compare, the window or the whole item, and ``start`` is the seed's place in them.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in parts:
            for item, text in zip(part.column(0), part.column(1), strict=True):
                words = known.of(letter_words(text.as_py()))
                span = min(SPAN, len(words))
                if span < LEAST:
                    continue
                signed = words.view(np.int64)

                def rows(hashes: np.ndarray, span: int, start: int, others: list, item=item) -> pa.RecordBatch:
                    n = len(others)
                    return pa.RecordBatch.from_arrays(
                        [pa.array(hashes.view(np.int64)), pa.array([span] * n, pa.int32()),
                         pa.array([start] * n, pa.int32()), pa.array(others, pa.list_(pa.int64())),
                         pa.array([item.as_py()] * n, part.column(0).type)],
                        ["hash", "span", "start", "other", "item_id"])

                for k in range(0, len(words) - span + 1, STEP):
                    piece = words[k : k + STEP + span - 1]
                    others = [signed[at : at + span].tolist() for at in range(k, k + len(piece) - span + 1)]
                    for hashes in masked_hashes(piece, span):
                        yield rows(hashes, span, 0, others)
                for start in seed_starts(len(words)):
                    hashes = masked_hashes(words[start : start + LEAST], LEAST)[:, 0]
                    yield rows(hashes.copy(), LEAST, start, [signed.tolist()] * len(hashes))

    kind = benchmark.schema[id_column].dataType.simpleString()
    return (
        benchmark.select(id_column, F.col(text_column).cast("string"))
        .mapInArrow(batches, f"hash long, span int, start int, other array<long>, item_id {kind}")
        .groupBy("hash", "span", "start", "other").agg(F.min("item_id").alias("item_id"))
    )


def _bitmap(index: DataFrame, bits: int) -> np.ndarray:
    """The filter; it reaches the driver as at most ``2 ** (bits - 6)`` words, however large the benchmark."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hashes = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells_of(hashes, bits)))], ["cell"])

    words = (
        index.select("hash").mapInArrow(batches, "cell long")
        .groupBy(F.shiftright("cell", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits"))
    )
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    for row in words.toLocalIterator():
        bitmap[row.word] = row.bits
    return bitmap.view(np.uint8)


def overlaps(docs: DataFrame, benchmark: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``(doc_id, text_sha256, at, item_id, equal)``: places of documents that agree with a benchmark window or item.

    ``at`` is the place's first word, ``equal`` the number of equal words, at least ``SIMILARITY``
    of the window or item. Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
    ``text_sha256`` is of the text as it is. Null texts and items count as empty; an item of under
    ``LEAST`` words is too short to tell a leak and is not looked for. Items with equal windows are
    given by the smallest id. Other columns are ignored.
    """
    index = pin(benchmark_windows(benchmark))
    spans = sorted(r.span for r in index.select("span").distinct().collect())  # LEAST to SPAN: five at most
    shared = docs.sparkSession.sparkContext.broadcast((_bitmap(index, bits), spans))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hits_of(part: pa.RecordBatch, first_row: int, texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Windows of several rows, one behind the other, that pass the filter."""
        bitmap, wanted = shared.value
        words = np.concatenate(texts)
        signed = words.view(np.int64)
        ends = np.cumsum([len(t) for t in texts])
        for span in wanted:
            reach = REACH if span == LEAST else 0
            for k in range(0, len(words) - span + 1, STEP):
                for hashes in masked_hashes(words[k : k + STEP + span - 1], span):
                    first, second = cells_of(hashes, bits)
                    at = np.flatnonzero(_is_set(bitmap, first))
                    at = at[_is_set(bitmap, second[at])]
                    row = np.searchsorted(ends, at + k, "right")
                    inside = at + k + span <= ends[row]  # not across two rows
                    at, row = at[inside], row[inside]
                    if not len(at):
                        continue
                    place = at + k
                    begin = ends[row] - np.array([len(texts[r]) for r in row.tolist()])
                    low, high = np.maximum(begin, place - reach), np.minimum(ends[row], place + span + reach)
                    taken = pa.array(row + first_row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes[at].view(np.int64)), pa.array([span] * len(at), pa.int32()),
                         pa.array([signed[x:y].tolist() for x, y in zip(low.tolist(), high.tolist(), strict=True)],
                                  pa.list_(pa.int64())),
                         pa.array((place - low).astype(np.int32)), part.column(0).take(taken),
                         part.column(2).take(taken), pa.array(place - begin)],
                        ["hash", "span", "around", "lead", "doc_id", "text_sha256", "place"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in parts:
            texts, held = [], 0
            for row, text in enumerate(part.column(1)):
                texts.append(known.of(letter_words(text.as_py())))
                held += len(texts[-1])
                if held >= STEP or row == part.num_rows - 1:
                    yield from hits_of(part, row + 1 - len(texts), texts)
                    texts, held = [], 0

    # the digest is computed beside the text, so that the result can be matched with rows of any id
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn(
        "text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    hits = source.mapInArrow(batches, "hash long, span int, around array<long>, lead int, "
                                      f"doc_id {kind}, text_sha256 string, place long")
    there = F.slice("around", F.greatest(F.col("lead") - F.col("start"), F.lit(0)) + 1, F.size("other"))
    # a place that ends before the item does has nulls for words, and so no number of equal ones
    equal = F.aggregate(F.zip_with(there, "other", lambda a, b: (a == b).cast("int")), F.lit(0), lambda x, y: x + y)
    return (
        hits.join(index, ["hash", "span"]).where("lead >= start")
        .select("doc_id", "text_sha256", (F.col("place") - F.col("start")).alias("at"), "item_id",
                F.size("other").alias("size"), equal.alias("equal"))
        .where(F.col("equal") >= F.ceil(F.col("size") * SIMILARITY))
        .select("doc_id", "text_sha256", "at", "item_id", "equal")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, items, windows)`` for each document id with a benchmark passage.

    The smallest item found, how many different ones, and at how many places. Clean documents have no row;
    all rows without an id are one.
    """
    return overlaps(docs, benchmark).groupBy("doc_id").agg(
        F.min("item_id").alias("item_id"), F.countDistinct("item_id").alias("items"),
        F.countDistinct("text_sha256", "at").alias("windows"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has no overlap with the benchmark."""
    leaked = pin(overlaps(docs, benchmark).select(F.col("text_sha256").alias("leaked")).distinct())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.join(leaked, F.sha2(text.cast("binary"), 256) == leaked["leaked"], "left_anti")

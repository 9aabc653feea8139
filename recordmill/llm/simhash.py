"""SimHash near-duplicates: fingerprints, and links between those that differ in few bits.

Links are found in an inverted index over the eight byte positions of a fingerprint.
Two fingerprints with at most four differing bits share at least four of eight
positional bytes. A posting of one byte would hold a 256th of all fingerprints, so
postings are keyed by the bytes at three positions: the twenty position triples below
are a Turán cover, of which every set of four positions holds at least one. In a posting
the shared positional bytes of each pair are tallied, pairs under the guaranteed minimum
are dropped, and the rest are verified bit by bit.

A posting sends on a star per connected group and not its pairs. A posting with more
than ``block`` fingerprints is cut into blocks; each pair of blocks is a task's work
of its own, so that no task holds more than two blocks of a posting.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.components import connected_components
from recordmill.plans.pins import pin

SHINGLE = 4
MAX_BITS = 4
BLOCK = 4096
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text over its word shingles, repeats included; 0 without words.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer
    words than ``shingle`` is one shingle. A bit is set if it is set in over half the hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], stop[:-1] + 1))
    if len(words) < shingle:
        start, stop = start[:1], stop[-1:]
    else:
        start, stop = start[: len(words) - shingle + 1], stop[shingle - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(start), CHUNK):
        pairs = zip(start[k : k + CHUNK].tolist(), stop[k : k + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in pairs], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = (ones * 2 > len(start)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``: one row per row of ``docs``; the fingerprint as a signed long."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in part.column(1)), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(batches, f"doc_id {kind}, fp long")


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of the positions 0 to 7 of which each four positions hold at least one.

    Positions fall into three classes (3, 3 and 2 of them). A triple is taken if it lies in one
    class, or has two positions in a class and one in the next.
    """
    group = (0, 0, 0, 1, 1, 1, 2, 2)

    def taken(triple: tuple[int, ...]) -> bool:
        n = [sum(group[p] == g for p in triple) for g in range(3)]
        return 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3))

    return [t for t in combinations(range(8), 3) if taken(t)]


def linked_pairs(posting: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within equal ``posting`` values (sorted) whose fingerprints differ in ``max_bits`` at most."""
    least_shared = 8 - max_bits
    left, right = [], []
    at, lag = np.arange(max(len(fp) - 1, 0)), 1
    while len(at):
        at = at[at + lag < len(fp)]
        at = at[posting[at] == posting[at + lag]]
        differ = fp[at] ^ fp[at + lag]
        tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        kept = np.flatnonzero(tally >= least_shared)
        kept = kept[np.bitwise_count(differ[kept]) <= max_bits]
        left.append(at[kept])
        right.append(at[kept] + lag)
        lag += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (at, at)


def stars(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` items the smallest item it is linked to, directly or through others."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _links_of(posting: np.ndarray, fp: np.ndarray, max_bits: int) -> pa.RecordBatch:
    left, right = linked_pairs(posting, fp, max_bits)
    if len(left):
        # the same fingerprint stands in many postings of a chunk: join them under one number
        values, number = np.unique(fp, return_inverse=True)
        label = stars(len(values), number[left], number[right])
        moved = np.flatnonzero(label != np.arange(len(values)))
        a, b = values[moved].view(np.int64), values[label[moved]].view(np.int64)
    else:
        a = b = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def fingerprint_links(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK,
                      chunk: int = 1 << 18) -> DataFrame:
    """``(a, b)``: links between the distinct fingerprints of ``nodes(fp)`` that connect all within ``max_bits``.

    Not every pair is given, but any two fingerprints within ``max_bits`` are joined by a path of links.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the position triples cover up to 4 differing bits")
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long")) for p in range(8)]
    keys = [
        F.lit(slot << 24).cast("long") + byte[a] * (1 << 16) + byte[b] * (1 << 8) + byte[c]
        for slot, (a, b, c) in enumerate(position_triples())
    ]
    index = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    blocks = (
        index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
        .select(F.col("key").alias("hot"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                    lambda j: F.least(own, j).cast("long") * F.col("blocks") + F.greatest(own, j))
    )
    dealt = (
        index.join(blocks, F.col("key") == F.col("hot"), "left")
        .select("key", "fp", F.explode(pairs).alias("pair"))
        .repartition("key", "pair").sortWithinPartitions("key", "pair")
    )

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def columns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return tuple(np.concatenate([h.column(c).to_numpy() for h in held]) for c in range(3))

        for part in parts:
            held.append(part)
            if sum(h.num_rows for h in held) < chunk:
                continue
            key, pair, fp = columns()
            change = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            if len(change):  # all but the last posting, which may go on
                cut = change[-1]
                number = np.searchsorted(change, np.arange(cut), side="right")
                yield _links_of(number, fp[:cut].view(np.uint64), max_bits)
                held = [pa.RecordBatch.from_arrays([pa.array(x[cut:]) for x in (key, pair, fp)], ["key", "pair", "fp"])]
        if held:
            key, pair, fp = columns()
            change = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            yield _links_of(np.searchsorted(change, np.arange(len(key)), side="right"), fp.view(np.uint64), max_bits)

    return dealt.select("key", "pair", "fp").mapInArrow(batches, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``max_bits`` differing
    bits. Equal texts share a fingerprint, are handled once, and count as linked. A null text
    counts as empty; texts without words have fingerprint zero. A null id is never a
    component's id unless the component has no other. Other columns are ignored.
    """
    prints = pin(with_fingerprint(docs, id_column, text_column, shingle))
    nodes = pin(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    members = connected_components(fingerprint_links(nodes, max_bits, block))
    rooted = nodes.join(members, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("print"), "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = pin(rooted.join(smallest, "root").select("print", "component_id"))
    return prints.join(classes, F.col("fp") == F.col("print"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Periodic runs of words: maximal stretches that repeat with their smallest period.

A run's Lyndon root is, under an order of the words or under its inverse, the longest Lyndon word
that starts where it stands. Phase one of Baier's suffix sorting gives those lengths: suffixes are grouped
by their first word, groups are taken from the highest to the lowest, and each member hands its
group's context on to the nearest earlier suffix of a lower group, which moves behind its own
group. When a group's turn comes its context is the longest Lyndon word at each of its members.
Each such root is extended to both sides by longest common extensions, read from ranks of the
substrings of 1, 2, 4, ... words, and kept if it then has the least length and two periods.

A word that a document holds once lies in no run, so a document is first cut at such words (and the
pieces at words that are single in them); pieces under the least length hold no run. Documents
are independent of each other: one pass, without a shuffle.
"""

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 12
CUTS = 4  # how often pieces are cut at single words; more would only save time
CHUNK_WORDS = 1 << 17

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def lyndon_lengths(letters: list[int], inverse: bool = False) -> list[int]:
    """Length of the longest Lyndon word at each place of ``letters`` (0 to k, all of them in use).

    Groups are named by the number of suffixes in lower groups, so names compare like groups; members
    that leave a group take the last names of its interval.
    """
    n = len(letters)
    members: dict[int, list[int]] = {}
    for place, letter in enumerate(letters):
        members.setdefault(letter, []).append(place)
    group, size, length, ending, at = [0] * n, {}, {}, {}, 0
    named: dict[int, list[int]] = {}
    for letter in sorted(members, reverse=inverse):
        named[at] = own = members[letter]
        size[at], length[at], ending[at + len(own)] = len(own), 1, at
        for place in own:
            group[place] = at
        at += len(own)
    lower, found, end = [-1] * n, [0] * n, n
    while end:
        now = ending[end]
        context = length[now]
        own = named.pop(now)
        end = now
        if len(own) > 1:
            own = sorted(place for place in own if group[place] == now)
        times: dict[int, int] = {}
        for place in own:
            found[place] = context
            back = place - 1
            while back >= 0 and group[back] > now:
                back = lower[back]
            if back >= 0 and group[back] == now:
                back = lower[back]
            lower[place] = back
            if back >= 0:
                times[back] = times.get(back, 0) + 1
        if len(times) == 1:
            moves = [((-times[back], group[back]), [back]) for back in times]
        else:
            together: dict[tuple[int, int], list[int]] = {}
            for back, many in times.items():
                together.setdefault((-many, group[back]), []).append(back)
            moves = sorted(together.items())  # whoever got most goes highest
        for (many, old), moved in moves:
            longer = length[old] - many * context
            if len(moved) == size[old]:
                length[old] = longer
                continue
            size[old] -= len(moved)
            new = old + size[old]
            ending[new + len(moved)], ending[new] = new, old
            size[new], length[new], named[new] = len(moved), longer, moved
            for place in moved:
                group[place] = new
    return found


class Extensions:
    """Longest common extensions in an array, from ranks of its substrings of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        ranks = np.unique(values, return_inverse=True)[1]
        self.levels = [ranks]
        while len(ranks) and ranks.max() + 1 < len(ranks):
            width = 1 << len(self.levels) - 1
            if len(ranks) <= width:
                break
            pairs = ranks[:-width].astype(np.int64) * (int(ranks.max()) + 1) + ranks[width:]
            ranks = np.unique(pairs, return_inverse=True)[1]
            self.levels.append(ranks)

    def ahead(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many values from ``left`` on equal those from ``right`` on; ``left`` is below ``right``."""
        far = np.zeros(len(left), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            ranks = self.levels[k]
            some = np.flatnonzero(right + far < len(ranks))
            same = some[ranks[left[some] + far[some]] == ranks[right[some] + far[some]]]
            far[same] += 1 << k
        return far

    def behind(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many values before ``left`` equal those before ``right``."""
        far = np.zeros(len(left), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            ranks, width = self.levels[k], 1 << k
            some = np.flatnonzero(left - far >= width)
            same = some[ranks[left[some] - far[some] - width] == ranks[right[some] - far[some] - width]]
            far[same] += width
        return far


def _stretches(numbers: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of ``numbers`` (equal for equal words of one document) that may hold runs."""
    starts, ends = np.zeros(1, np.int64), np.full(1, len(numbers), np.int64)
    for _ in range(CUTS):
        lengths = ends - starts
        places = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        piece = np.repeat(np.arange(len(starts)), lengths)
        ranks, counts = np.unique(piece * (int(numbers.max(initial=0)) + 1) + numbers[places],
                                  return_inverse=True, return_counts=True)[1:]
        again = counts[ranks] > 1
        stays = np.zeros(len(numbers) + 1, bool)
        stays[places[again]] = True
        begins = stays[:-1] & ~np.concatenate(([False], stays[:-2]))
        begins[starts] |= stays[starts]  # neighbouring pieces stay apart
        first = np.flatnonzero(begins)
        stops = np.ones(len(numbers) + 1, bool)
        stops[:-1] = ~stays[:-1] | begins
        last = np.flatnonzero(stops)
        after = last[np.searchsorted(last, first, side="right")]
        long = after - first >= least
        if len(starts) == long.sum() and (after[long] - first[long]).sum() == lengths.sum():
            break
        starts, ends = first[long], after[long]
        if not len(starts):
            break
    return starts, ends


def runs_of(numbers: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period), by start and then period, of all runs of at least ``least`` words in ``numbers``."""
    starts, ends = _stretches(numbers, least) if len(numbers) >= max(least, 2) else ([], [])
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    parts, places, roots, at = [], [], [], 0
    apart = int(numbers.max()) + 1
    for begin, end in zip(starts.tolist(), ends.tolist(), strict=True):
        own = numbers[begin:end]
        letters = np.unique(own, return_inverse=True)[1].tolist()
        here = np.arange(at, at + len(own))
        for inverse in (False, True):
            roots.append(np.array(lyndon_lengths(letters, inverse)))
            places.append(here)
        parts += [own, [apart]]  # a value of its own behind each stretch
        apart += 1
        at += len(own) + 1
    extensions = Extensions(np.concatenate(parts))
    where = np.concatenate([np.arange(b, e + 1) for b, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    place, period = np.concatenate(places), np.concatenate(roots)
    first = place - extensions.behind(place, place + period)
    length = place + period + extensions.ahead(place, np.minimum(place + period, extensions.n - 1)) - first
    kept = length >= np.maximum(2 * period, least)
    return np.unique(np.stack([where[first[kept]], period[kept], length[kept]], axis=1), axis=0)[:, [0, 2, 1]]


class _Numbers(dict):
    """Numbers of words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _chunk(texts: list[str | None], least: int) -> pa.RecordBatch:
    """Runs and collapsed texts of some documents."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(words) + 1 for words in split])))
    parts, base = [], 0
    for words in split:
        known = _Numbers()
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)) + base)
        base += len(known) + 1
        parts.append([base - 1])  # between documents, a word of its own
    found = runs_of(np.concatenate(parts), least)
    start, length, period = found.T
    turns = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(turns, start + period, 1)
    np.add.at(turns, start + length, -1)
    keep = np.cumsum(turns) == 0
    collapsed = [
        b" ".join(words if keep[a : a + len(words)].all() else compress(words, keep[a : a + len(words)].tolist()))
        for a, words in zip(bounds[:-1].tolist(), split, strict=True)]
    owner = np.searchsorted(bounds, start, side="right") - 1
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    fields = [pa.array(x) for x in (start - bounds[owner], length, period)]
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                    pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    words = pa.array([len(w) for w in split], pa.int64())
    return pa.RecordBatch.from_arrays([words, runs, pa.array(collapsed, pa.binary()).cast(pa.string())],
                                      ["n_words", "runs", "collapsed"])


def word_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``, one row per row of ``docs``.

    Words are runs of anything but ASCII white space. ``runs`` holds each maximal stretch of ``least`` words and
    two periods or more as (start, length, period), by start and period; ``collapsed`` is the text
    without the words behind a run's first period, joined by one space. A null or empty text has no
    words, no runs and an empty collapsed text. Ids may be null or repeat; other columns are ignored;
    an empty table gives an empty result.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            begin, held = 0, 0
            sizes = [len(t) // 4 if (t := x.as_py()) else 0 for x in part.column(1)]
            for row, size in enumerate([*sizes, 0]):
                if row == part.num_rows or (held and held + size > CHUNK_WORDS):
                    if row > begin:
                        some = part.slice(begin, row - begin)
                        found = _chunk(some.column(1).to_pylist(), least)
                        yield pa.RecordBatch.from_arrays([some.column(0), *found.columns], ["doc_id", *found.schema.names])
                    begin, held = row, 0
                held += size

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(
        batches, f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string")


def with_periodic_tails(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` where every tenth document, by the CRC-32 of its id, repeats a stretch of its words to the end.

    With g the CRC-32 by ten: the words from number ``g % n`` on repeat with a period of about a third to a tenth
    of them. A null id leaves its text as it is.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.col(text_column)
    tailed = docs.select(  # the columns in a struct, so none of them is taken for the one added
        F.struct("*").alias("doc"), F.struct(
            F.floor(crc / 10).alias("g"),
            F.when(crc % 10 == 0, F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words")).alias("tail"))
    words = F.col("tail.words")
    n = F.when(F.size(words) > 0, F.size(words))
    start = (F.col("tail.g") % n).cast("int")
    period = (1 + F.floor((n - start) / (3 + F.col("tail.g") % 8))).cast("int")
    repeats = F.ceil((n - start) / period).cast("int")
    whole = F.array_join(F.concat(F.slice(words, F.lit(1), start), F.slice(
        F.flatten(F.array_repeat(F.slice(words, start + 1, period), repeats)), F.lit(1), n - start)), " ")
    doc = {c: F.col("doc").getField(c) for c in docs.columns}
    doc[text_column] = F.when(n.isNotNull(), whole).otherwise(doc[text_column])
    return tailed.select(*[column.alias(name) for name, column in doc.items()])


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each document, and digests of all its runs and of its collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))

    def sha(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))

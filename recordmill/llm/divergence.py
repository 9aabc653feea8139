"""How far the sources of a language diverge from each other, and which terms set a source apart.

Terms are counted per (language, source) in tasks, then summed. A language's vocabulary is dealt by hash into
shards of some thousand terms, numbered within their shard, so a group's counts become sorted
(term id, count) arrays of bounded length. Every unordered pair of groups of a language is one merge per
shard: the two arrays are co-grouped, a galloping intersection finds the terms of both, and overlaps, one-sided
terms and terms absent from both are priced in both directions at once. Shard sums are added up.
Languages of many sources fall into blocks of sources; a pair of blocks is a task's work of its own.

Shares are whole billionths and all arithmetic is on integers, so results do not depend on the order of
additions.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill.plans.pins import pin

LEAST_DOCUMENTS = 3
UNIT = 1_000_000_000
TERM_RANKS = 200
SHARD_TERMS = 4096
BLOCK_SOURCES = 32
HELD_TERMS = 200_000  # counted terms a task holds before it sends them on

#: letters of ASCII in lower case and all bytes of other characters stay; everything else parts terms
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of letters A-Z, a-z and non-ASCII characters, with A-Z in lower case."""
    return (text or b"").translate(_TERM_BYTES).split(b" ")


def term_counts(docs: DataFrame, text_column: str = "text", held: int = HELD_TERMS) -> DataFrame:
    """``(lang, source, term, n, docs)`` of ``docs(lang, source, text)``: occurrences, and documents that hold the term."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, documents) in groups.items():
                n.pop(b"", None)
                if not n:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(n)), pa.repeat(source, len(n)), pa.array(list(n), pa.binary()).cast(pa.string()),
                     pa.array(list(n.values()), pa.int64()), pa.array([documents[t] for t in n], pa.int64())],
                    ["lang", "source", "term", "n", "docs"])
            groups.clear()

        for part in parts:
            keys = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
            for key, text in zip(keys, part.column(2), strict=True):
                found = terms_of(text.as_py())
                n, documents = groups.setdefault(key, (Counter(), Counter()))
                size -= len(n)
                n.update(found)
                documents.update(set(found))
                size += len(n)
                if size > held:
                    yield from sent()
                    size = 0
        yield from sent()

    counted = docs.select("lang", "source", F.col(text_column).cast("string").cast("binary").alias("text"))
    return counted.mapInArrow(batches, "lang string, source string, term string, n long, docs long").groupBy(
        "lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(UNIT * (n + 1) / (total + kept))`` in whole numbers of any size."""
    return (F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"),
                                       (total + kept).cast("decimal(20,0)"))).cast("long")


def shares(n: np.ndarray, whole: int) -> np.ndarray:
    """``1 + floor(UNIT * (n + 1) / whole)`` by long division, so that no product overflows."""
    part, left = np.divmod(n + 1, whole)
    for _ in range(3):
        digits, left = np.divmod(left * 1000, whole)
        part = part * 1000 + digits
    return part + 1


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def gallop(few: np.ndarray, many: np.ndarray, stride: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted arrays ``few`` and ``many`` at which equal ids stand.

    For every ``stride`` ids of ``few`` the place in ``many`` is found in steps that double, from the last
    place on; only the stretch stepped over is then searched.
    """
    left, right, at = [], [], 0
    for k in range(0, len(few), stride):
        some = few[k : k + stride]
        last, step, end = int(some[-1]), 1, at
        while end < len(many) and many[end] <= last:
            end += step
            step *= 2
        place = at + np.searchsorted(many[at:end], some)
        inside = place < len(many)
        hit = np.flatnonzero(inside)[many[place[inside]] == some[inside]]
        left.append(k + hit)
        right.append(place[hit])
        at = int(place[-1])
        if at == len(many):
            break
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


class Side:
    """A group's terms within one shard: sorted ids, their shares, and the share of a term that it lacks."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, total: int, kept: int) -> None:
        self.ids = ids
        whole = total + kept
        self.p = shares(n, whole) if whole else n
        self.none = shares(np.zeros(1, np.int64), whole) if whole else np.ones(1, np.int64)


def merged(a: Side, b: Side, size: int) -> tuple[int, int]:
    """Prices of ``a`` against ``b`` and of ``b`` against ``a`` over a shard of ``size`` terms."""
    if len(a.ids) <= len(b.ids):
        i, j = gallop(a.ids, b.ids)
    else:
        j, i = gallop(b.ids, a.ids)
    only_a, only_b = np.ones(len(a.ids), bool), np.ones(len(b.ids), bool)
    only_a[i] = only_b[j] = False
    absent = size - len(a.ids) - len(b.ids) + len(i)

    def one_way(x: Side, y: Side, at_x: np.ndarray, at_y: np.ndarray, only_x: np.ndarray, only_y: np.ndarray) -> int:
        return (int(prices(x.p[at_x], y.p[at_y]).sum()) + int(prices(x.p[only_x], y.none).sum())
                + int(prices(x.none, y.p[only_y]).sum()) + absent * int(prices(x.none, y.none)[0]))

    return one_way(a, b, i, j, only_a, only_b), one_way(b, a, j, i, only_b, only_a)


PAIR = "lang string, source string, item string, value long"


def _pair_values(key: tuple, lower: pa.Table, upper: pa.Table) -> pa.Table:
    """All unordered pairs between two blocks of sources (or within one) in a shard."""

    def sides(table: pa.Table) -> list[tuple[str, Side]]:
        def one(row: int) -> tuple[str, Side]:
            cells = table.column("cells")[row].values.flatten() if len(table.column("cells")[row]) else None
            ids, n = (c.to_numpy() for c in cells) if cells else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            return table.column("source")[row].as_py(), Side(
                ids, n, table.column("total")[row].as_py(), table.column("kept")[row].as_py())

        return sorted((one(row) for row in range(table.num_rows)), key=lambda s: s[0])

    lang, size = key[0].as_py(), (lower if lower.num_rows else upper).column("size")[0].as_py()
    own = key[2].as_py() == key[3].as_py()
    left, right = sides(lower), sides(upper)
    source, item, value = [], [], []
    for k, (a, side_a) in enumerate(left):
        for b, side_b in left[k + 1 :] if own else right:
            for x, y, priced in zip((a, b), (b, a), merged(side_a, side_b, size), strict=True):
                source.append(x)
                item.append(y)
                value.append(priced)
    return pa.table({"lang": pa.repeat(lang, len(source)), "source": pa.array(source, pa.string()),
                     "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def divergence(docs: DataFrame, text_column: str = "text", least_documents: int = LEAST_DOCUMENTS,
               term_ranks: int = TERM_RANKS, shard_terms: int = SHARD_TERMS,
               block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: a source's divergence from each other one, and its terms.

    A language keeps the terms that at least ``least_documents`` of its documents hold. With p a
    group's share of a term and q another's, a term's price is ``floor((p - q)^2 / q)``. Part ``pair`` has for each
    other source of the language the sum over all kept terms (0 if none is kept); part ``term`` has the group's
    terms above the language's own share, up to rank ``term_ranks``. Null texts, languages and sources
    count as empty. A group without kept terms has pairs but no terms; the only group of a language without
    kept terms has no rows. Other columns are ignored; an empty table gives an empty result.
    """
    def blank(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    named = docs.select(blank("lang"), blank("source"), blank(text_column))
    counts = pin(term_counts(named, text_column))
    vocabulary = pin(
        counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least_documents).select("lang", "term", "n"))
    groups = pin(named.select("lang", "source").distinct())
    langs = pin(groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(
        vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total")), "lang", "left")
        .select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
                F.greatest(F.ceil(F.col("kept") / shard_terms), F.lit(1)).cast("int").alias("shards"),
                F.ceil(F.col("sources") / block_sources).cast("int").alias("blocks")))
    place = Window.partitionBy("lang", "shard").orderBy("term")
    terms = (
        vocabulary.join(langs.select("lang", "shards"), "lang")
        .select("lang", "term", F.col("n").alias("lang_n"),
                F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
        .withColumn("id", F.row_number().over(place) - 1))
    entries = pin(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]))
    totals = pin(groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
                 .join(langs, "lang").withColumn("total", F.coalesce("total", F.lit(0))))

    sizes = entries.groupBy("lang", "shard").agg((F.max("id") + 1).alias("size"))
    everywhere = totals.select("lang", "source", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    cell = F.struct("id", "n")
    arrays = (
        entries.select("lang", "source", "shard", cell.alias("cell"))
        .unionByName(everywhere.withColumn("cell", F.lit(None).cast("struct<id:int,n:bigint>")))
        .groupBy("lang", "source", "shard").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
        .join(pin(sizes), ["lang", "shard"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
        .join(totals.select("lang", "source", "total", "kept", "blocks"), ["lang", "source"])
        .withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")))
    arrays = pin(arrays)
    lower = arrays.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).select(
        "lang", "shard", F.col("block").alias("low"), F.col("other").alias("high"), "source", "cells", "size", "total", "kept")
    upper = arrays.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block")))).where("other < block").select(
        "lang", "shard", F.col("other").alias("low"), F.col("block").alias("high"), "source", "cells", "size", "total", "kept")
    key = ["lang", "shard", "low", "high"]
    priced = lower.groupBy(*key).cogroup(upper.groupBy(*key)).applyInArrow(_pair_values, PAIR)
    pairs = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = [F.col("value").desc(), F.col("item")]
    best = Window.partitionBy("lang", "source").orderBy(*order)
    ranked_pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                                F.row_number().over(best).cast("int").alias("rank"))
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    above = (
        entries.join(totals.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
        .select("lang", "source", "shard", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
        .select("lang", "source", "shard", "item", F.expr("(p - q) * (p - q) div q").alias("value")))
    # first within a shard, so that what meets in a group's last ranking is a few rows per shard
    within = Window.partitionBy("lang", "source", "shard").orderBy(*order)
    first = above.withColumn("place", F.row_number().over(within)).where(F.col("place") <= term_ranks)
    ranked_terms = first.select("lang", "source", F.lit("term").alias("part"), "item", "value",
                                F.row_number().over(best).cast("int").alias("rank")).where(F.col("rank") <= term_ranks)
    return ranked_pairs.unionByName(ranked_terms)

"""Near-duplicate vectors: random-hyperplane signatures in several tables, exact cosines, components.

A table's key is the signs of a vector's projections on some random directions; two vectors at angle a agree in one
sign with probability 1 - a/pi. The number of signs follows the number of vectors, so that
unlike vectors meet in small buckets, and the number of tables follows from it, so that a pair just at the least
cosine shares a bucket with probability ``recall`` (closer pairs more often). All vectors of a bucket are compared.

Equal vectors are one node with a count. A bucket of more than ``block`` nodes is cut into blocks, and each pair of
blocks is a task's work of its own. A pair that shares several buckets counts in the first table it
shares, which its keys tell, so degrees are sums and no list of pairs is made; for the components a
bucket sends a star per connected group.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.components import connected_components
from recordmill.llm.simhash import stars
from recordmill.plans.pins import pin

LEAST_COSINE = 0.95
RECALL = 0.999
BUCKET = 32  # rows that a bucket would have if directions were spread evenly
BLOCK = 1024
SEED = 13


def tables_for(rows: int, least: float = LEAST_COSINE, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Signs per table and number of tables for so many different vectors."""
    signs = min(60, max(6, math.ceil(math.log2(max(rows, 1) / bucket))))
    together = (1 - math.acos(least) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(1 - recall) / math.log1p(-together))) if together < 1 else 1


def planes(dim: int, signs: int, table: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, table]).standard_normal((dim, signs))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; none of them is zero. Scaled first, so squares stay finite."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite numbers, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _signed(nodes: DataFrame, signs: int, tables: int) -> DataFrame:
    """``nodes(node, copies, vector)`` with ``dim`` and the ``keys`` of all tables."""
    weights = 1 << np.arange(signs, dtype=np.int64)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, list[np.ndarray]] = {}
        for part in parts:
            vectors = part.column(2)
            dims = vectors.value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                some = pa.array(np.flatnonzero(dims == dim))
                if dim not in directions:
                    directions = {dim: [planes(dim, signs, t) for t in range(tables)]}
                rows = unit(_matrix(vectors.take(some)))
                keys = np.stack([((rows @ d) > 0) @ weights for d in directions[dim]], axis=1)
                offsets = pa.array(np.arange(len(rows) + 1) * tables, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(some) for k in range(3)), pa.array(np.full(len(rows), dim), pa.int32()),
                     pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                    ["node", "copies", "vector", "dim", "keys"])

    kind = nodes.schema["vector"].dataType.simpleString()
    return nodes.select("node", "copies", "vector").mapInArrow(
        batches, f"node long, copies long, vector {kind}, dim int, keys array<bigint>")


def _links(rows: pa.RecordBatch, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one bucket (or pair of its blocks) that have links: node, the star it hangs on, copies linked."""
    node, copies, own = (rows.column(c).to_numpy() for c in ("node", "copies", "own"))
    vectors, table = unit(_matrix(rows.column("vector"))), rows.column("slot")[0].as_py()
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    if low == high:
        left, right = np.nonzero(np.triu(vectors @ vectors.T >= least, 1))
    else:
        first, second = np.flatnonzero(own == low), np.flatnonzero(own == high)
        left, right = np.nonzero(vectors[first] @ vectors[second].T >= least)
        left, right = first[left], second[right]
    keys = _matrix(rows.column("keys")) if len(left) and table else None
    for earlier in range(table):
        if not len(left):
            break
        new = keys[left, earlier] != keys[right, earlier]
        left, right = left[new], right[new]
    linked = np.zeros(len(node), np.int64)
    np.add.at(linked, left, copies[right])
    np.add.at(linked, right, copies[left])
    star = stars(len(node), left, right)
    some = np.flatnonzero(linked)
    return node[some], node[star[some]], linked[some]


def _verified(dealt: DataFrame, least: float) -> DataFrame:
    """``(node, star, links)`` from rows that arrive sorted by bucket and pair of blocks."""
    bucket = ("dim", "slot", "key", "low", "high")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def found(rows: pa.RecordBatch, ends: list[int]) -> Iterator[pa.RecordBatch]:
            columns = [_links(rows.slice(a, b - a), least) for a, b in zip([0, *ends[:-1]], ends, strict=True) if b - a > 1]
            if columns:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], ["node", "star", "links"])

        for part in parts:
            held = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            changes = np.zeros(max(held.num_rows - 1, 0), bool)
            for c in bucket:
                values = held.column(c).to_numpy()
                changes |= values[1:] != values[:-1]
            ends = (np.flatnonzero(changes) + 1).tolist()
            if ends:  # all but the last bucket, which may go on
                yield from found(held.slice(0, ends[-1]), ends)
                held = held.slice(ends[-1])
        if held is not None and held.num_rows:
            yield from found(held, [held.num_rows])

    return dealt.mapInArrow(batches, "node long, star long, links long")


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
                 least: float = LEAST_COSINE, recall: float = RECALL, bucket: int = BUCKET,
                 block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Two vectors are linked when their cosine in double precision is ``least`` or more; ``n_links`` counts the
    other rows linked directly, copies included. ``component_id`` is the smallest id reachable over links, and
    the row that has it is ``kept`` (all such rows, where ids repeat). Vectors that are null, empty or zero, hold a null
    or a component that is not finite, or have another dimension link with nothing. A null id is a
    component's only where no other id is reachable. Other columns are ignored; an empty table gives an empty result.
    """
    if not 0 < least <= 1:
        raise ValueError("the least cosine lies above 0 and is 1 at most")
    vector = F.col(vector_column)
    rows = vectors.select(F.col(id_column).alias("vec_id"), vector.alias("vector"), usable(vector).alias("usable"))
    usable_rows, others = rows.where("usable").drop("usable"), rows.where("not usable")
    nodes = pin(
        usable_rows.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()))
    signs, tables = tables_for(nodes.count(), least, recall, bucket)
    signed = pin(_signed(nodes, signs, tables))

    index = signed.select("node", "dim", F.posexplode("keys").alias("slot", "key"))
    shared = pin(
        index.groupBy("dim", "slot", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("dim", "slot", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = index.join(shared, ["dim", "slot", "key"]).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("node", "dim", "slot", "key", "own",
                             F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    deal = ["dim", "slot", "key", "low", "high"]
    dealt = (
        members.join(signed.select("node", "copies", "vector", "keys"), "node")
        .repartition(*deal).sortWithinPartitions(*deal)
        .select(*deal, "own", "node", "copies", "vector", "keys"))
    found = pin(_verified(dealt, least))

    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("star").alias("b")))
    classes = (
        nodes.join(degrees, "node", "left").join(roots, "node", "left")
        .select("vector", "first", F.coalesce("root", "node").alias("root"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    classes = pin(classes)
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = pin(classes.join(smallest, "root").select(F.col("vector").alias("same"), "n_links", "component_id"))
    labelled = usable_rows.join(labels, F.col("vector") == F.col("same")).select("vec_id", "n_links", "component_id")
    alone = others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return labelled.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

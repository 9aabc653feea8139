"""Connected components of a link table, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.plans.pins import pin


def _neighbour_minimum(edges: DataFrame) -> DataFrame:
    """``(u, v, m)``: each edge with the smallest of ``u`` and all its neighbours.

    The minimum is an aggregate joined back, not a list, so a node with very many
    neighbours is combined before the shuffle and split by the skew join.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), "least")
    return edges.join(least, F.col("u") == F.col("node")).select("u", "v", F.least("u", "least").alias("m"))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
    return tuple(row)


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node reachable.

    Each round hangs neighbours under smaller nodes (large star, then small star); the
    number of rounds grows with the logarithm of the longest chain. Every round is
    written to the shared folder, which cuts the plan and outlives lost executors.
    Self links and null nodes are ignored; an empty table gives an empty result.
    """
    edges = pin(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and a <> b").distinct()
    )
    before = _signature(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _neighbour_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = _neighbour_minimum(large)  # every v is below its u here
        edges = pin(
            down.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle; raise `rounds`")
    # every edge now points at its root, which is no edge's upper end
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()

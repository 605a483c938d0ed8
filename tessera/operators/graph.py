"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.work import discard, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", kept: bool = False) -> DataFrame:
    """(node, component): the least node reachable from each node of an edge.

    Large-star and small-star steps (Kiveris et al., 2014) need O(log^2 n) rounds
    and keep every round's edges linear in the input. A node's least neighbour is an
    aggregate, combined before the shuffle, that is joined back: no hub's edges meet in
    one window. A round's edges are written to the shared folder, and those of the round
    before deleted. So are the edges given, unless ``kept`` says that they come straight from
    a written table; where they repeat, they fall together in the first round. Null ends are ignored; self-loops name lone nodes. Nodes of any
    ordered type; longs are fastest (``numbered_nodes``)."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    pairs = pairs if kept else written(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # large star: every larger neighbour hangs on the least of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        # small star: u and its smaller neighbours hang on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, now = now, written(small, "edges")
        discard(large, *([before] if mark else []))
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    label = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def numbered_nodes(nodes: DataFrame, name: str) -> DataFrame:
    """(name, n): the distinct values of a column numbered by longs, written so that the numbers stay."""
    return written(nodes.select(name).where(F.col(name).isNotNull()).distinct().withColumn("n", F.monotonically_increasing_id()), "numbered")

"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campanula.llm.common import cut

#: Edges that a task of a round writes; every file written to a local folder starts processes.
EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (u, v): root is the least node it reaches.

    Every round is written to the checkpoint folder, so that no lineage grows. Minima
    are combined before their shuffle and joined from written tables, where adaptive
    execution can split the rows of a node with very many neighbours. The tasks that
    write a round grow with its edges, and are no fewer than the cluster's cores.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    edges = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while True:
        tasks = max(cores, -(-2 * state[0] // EDGES))
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks))
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))
        small = large.join(least, "u")
        edges = cut(
            small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
            .coalesce(tasks)
        )
        old, state = state, _state(edges)
        if state == old:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

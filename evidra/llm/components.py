"""Connected components of an edge table by repeated contraction: a few joins a round, nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import written

#: Rows of one file of a round's tables.
ROWS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges(a, b), undirected; component is the smallest node it reaches.

    Edges with a null end, loops and repeated edges don't matter; nodes without edges aren't returned. In each round
    every node points to its smallest neighbour (or itself), pointers are followed twice, and the edges move to where
    their ends point; the smallest node of a component always stays. A hub costs a partial aggregate, never one task."""
    links = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while n := links.count():  # from the files' footers
        parts = -(-2 * n // ROWS)  # no table of a round has more than 2n rows: few files for few rows
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        pointers = written(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("component")).coalesce(parts))
        for _ in range(2):
            further = pointers.select(F.col("node").alias("component"), F.col("component").alias("next")).where("component <> next")
            pointers = written(pointers.join(further, "component", "left").select("node", F.coalesce("next", "component").alias("component")).coalesce(parts))
        moved = pointers.where("node <> component")
        for end in ("a", "b"):
            to = moved.select(F.col("node").alias(end), F.col("component").alias("to"))
            links = links.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().coalesce(parts))
        rounds.append(pointers)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    found = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("component"), F.col("component").alias("next"))
        found = found.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return found if len(rounds) == 1 else written(found)

"""Connected components by contraction, without collecting nodes, links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._space import Workspace


def components(space: Workspace, links: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b long); comp is the same for all nodes of a component.

    Each round points every node at its smallest neighbour, follows pointers twice, rewrites the links to the nodes
    they point at and drops links inside a node, so that the number of nodes at least halves.  Every table is written,
    hence the joins have plain exchanges on both sides and skewed ones can be split at run time.
    """
    edges = space.put(links.select("a", "b").where("a <> b").distinct(), f"{name}-edges0", True)
    labels = None
    for i in range(rounds):
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
        point = space.put(both.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("p")), f"{name}-point{i}", True)
        for jump in ("x", "y"):
            up = point.select(F.col("n").alias("p"), F.col("p").alias("q"))
            point = space.put(point.join(up, "p").select("n", F.col("q").alias("p")), f"{name}-point{i}{jump}", True)
        if labels is None:
            labels = point.select(F.col("n").alias("node"), F.col("p").alias("comp"))
        else:
            up = point.select(F.col("n").alias("comp"), "p")
            labels = space.put(labels.join(up, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), f"{name}-labels{i}", True)
        to_a, to_b = point.select(F.col("n").alias("a"), F.col("p").alias("pa")), point.select(F.col("n").alias("b"), F.col("p").alias("pb"))
        edges = space.put(edges.join(to_a, "a").join(to_b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}-edges{i + 1}", True)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")) if labels is None else labels

"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.sources.scratch import drop_table, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int | None = None) -> DataFrame:
    """Returns id and component (the smallest id of the component) for every id on an edge.

    Each round points every node at its smallest neighbour, follows the pointers to their roots, and contracts the
    edges between roots; the number of roots at least halves, so rounds grow with the logarithm of the nodes. All
    steps are aggregations and equi-joins, which split hot nodes; only counts reach the driver. Self-loops and
    repeated edges do no harm; edges with a null end are left out. max_rounds stops early (labels are then partial).
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    e = materialize(e.filter("x and y").select("a", "b").distinct(), "edges")
    loops = e.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    left = e.filter("a <> b")
    labels, rounds = None, 0
    while not left.isEmpty() and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        both = left.select(F.col("a").alias("id"), F.col("b").alias("p")).unionByName(left.select(F.col("b").alias("id"), F.col("b").alias("p")))
        root = materialize(both.groupBy("id").agg(F.min("p").alias("p")), "roots")
        while True:
            x, y = root.alias("x"), root.alias("y")
            # A node whose pointer is a root already stays; the rest take their pointer's pointer.
            step = materialize(x.join(y, F.col("x.p") == F.col("y.id")).select(F.col("x.id").alias("id"), F.col("y.p").alias("p"), (F.col("x.p") != F.col("y.p")).alias("moved")), "roots")
            drop_table(root)
            moved = step.filter("moved").isEmpty()
            root = step
            if moved:
                break
        root = root.drop("moved")
        if labels is None:
            labels = root.select("id", F.col("p").alias("component"))
        else:
            onward = labels.alias("l").join(root.alias("r"), F.col("l.component") == F.col("r.id"), "left")
            labels = materialize(onward.select(F.col("l.id").alias("id"), F.coalesce("r.p", "l.component").alias("component")), "labels")
        up = left.join(root.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a").join(root.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
        left = materialize(up.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).filter("a <> b").distinct(), "edges")
    if labels is None:
        return loops
    alone = loops.join(labels.select("id"), "id", "left_anti")
    return labels.unionByName(alone)

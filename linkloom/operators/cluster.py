"""Single-linkage clusters: connected components of a similarity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.sources.scratch import materialize

from .components import connected_components
from .similarity import near_duplicate_sets


def cluster(points: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """id, cluster (smallest member) of every point; points without an edge stand alone; no points, no clusters."""
    found = connected_components(edges)
    return points.select(F.col(key).alias("id")).distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def near_duplicate_clusters(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """id, cluster (smallest member) of documents linked by near duplicates; works on sets, so copies cost a row each."""
    names, _, links = near_duplicate_sets(docs, key=key, text=text, **options)
    sets = materialize(cluster(names, links, "set"), "clusters").withColumnRenamed("id", "set")
    placed = materialize(names.select("doc", "set").join(sets, "set").select("doc", "cluster"), "placed")
    least = placed.groupBy("cluster").agg(F.min("doc").alias("_least"))
    found = placed.join(least, "cluster").groupBy(F.col("doc").alias("id")).agg(F.min("_least").alias("_least"))
    return docs.select(F.col(key).alias("id")).distinct().join(found, "id", "left").select("id", F.coalesce("_least", "id").alias("cluster"))


def cluster_n_iters(points: DataFrame, edges: DataFrame, iters: int, key: str = "id") -> DataFrame:
    """At most `iters` passes; in each every point takes the smallest cluster among its neighbours' and its own."""
    e = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = points.select(F.col(key).alias("id")).distinct().withColumn("cluster", F.col("id"))
    for _ in range(iters):
        best = e.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("other"))
        labels = materialize(labels.join(best, "id", "left").select("id", F.least("cluster", F.coalesce("other", "cluster")).alias("cluster")), "clusters")
    return labels


def merges(left: DataFrame, right: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of clusters (id, cluster tables) that any similar pair connects."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(left.select(F.col("id").alias("a"), F.col("cluster").alias("left")), "a").join(right.select(F.col("id").alias("b"), F.col("cluster").alias("right")), "b").select("left", "right").distinct()


def assign(clusters: DataFrame, points: DataFrame, edges: DataFrame) -> DataFrame:
    """id and index: the first cluster (table id, cluster as a number) with a similar member, else -1."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hit = both.join(clusters.select(F.col("id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("index"))
    return points.select("id").distinct().join(hit, "id", "left").select("id", F.coalesce("index", F.lit(-1)).alias("index"))


def assign_online(clusters: DataFrame, arrivals: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds new points one wave at a time without ever merging clusters: a point joins the newest cluster with a
    similar member, else opens one. clusters: id, cluster (number, newest highest); arrivals: id, seq.

    Waves are the longest chains of similar arrivals, so the loop is as long as such a chain, not as the table.
    """
    near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    placed = materialize(clusters.select("id", F.col("cluster").cast("long").alias("cluster")), "online")
    top = placed.agg(F.coalesce(F.max("cluster"), F.lit(-1))).first()[0]
    waiting = materialize(arrivals.select("id", "seq").join(placed.select("id"), "id", "left_anti"), "waiting")
    while not waiting.isEmpty():
        earlier = near.join(waiting.select(F.col("id").alias("a"), F.col("seq").alias("sa")), "a").join(waiting.select(F.col("id").alias("b"), F.col("seq").alias("sb")), "b").filter("sb < sa")
        ready = waiting.join(earlier.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
        hit = near.join(placed.select(F.col("id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.max("cluster").alias("cluster"))
        # A new cluster's number follows its first member's arrival.
        step = materialize(ready.join(hit, "id", "left").select("id", F.coalesce("cluster", F.lit(top + 1) + F.col("seq")).alias("cluster")), "online")
        placed = materialize(placed.unionByName(step), "online")
        waiting = materialize(waiting.join(step.select("id"), "id", "left_anti"), "waiting")
    return placed


def cluster_urls(clusters: DataFrame) -> DataFrame:
    """cluster, size and urls (sorted), largest first."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("id")).alias("urls")).orderBy(F.desc("size"), "cluster")


def entry_points(clusters: DataFrame, url: str = "url") -> DataFrame:
    """Distinct entry URLs of each cluster."""
    return clusters.groupBy("cluster").agg(F.count_distinct(url).alias("n_urls"))

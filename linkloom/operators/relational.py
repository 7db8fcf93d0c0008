"""Collection idioms as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.sources.scratch import materialize


def merge_with(left: DataFrame, right: DataFrame, on: list[str], value: str, combine) -> DataFrame:
    """All keys of both; combine(a, b) where both have one, else the one there is."""
    b = right.select(*on, F.col(value).alias("_b"))
    both = left.select(*on, F.col(value).alias("_a")).join(b, on, "full_outer")
    return both.select(*on, F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(combine(F.col("_a"), F.col("_b"))).alias(value))


def merge_maps(tables: list[DataFrame], on: list[str], last_wins: bool = True) -> DataFrame:
    """Rows by key from several tables; of one key that of the last (or first) table."""
    every = None
    for i, t in enumerate(tables):
        own = t.withColumn("_p", F.lit(i))
        every = own if every is None else every.unionByName(own)
    # Rows of one key in one table tie; the least by hash is taken, so reruns agree.
    rest = F.xxhash64(*(c for c in tables[0].columns if c not in on)) if set(tables[0].columns) - set(on) else F.lit(0)
    w = Window.partitionBy(*on).orderBy(F.desc("_p") if last_wins else F.asc("_p"), rest)
    return every.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_p")


def distinct_by(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key; the result in reverse order."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").orderBy(F.desc(order))


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows numbered from 1 in the order given, without one task for all: ranges in order, each with the rows before it."""
    own = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    part = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    row = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return own.join(F.broadcast(part.select("_part", before.alias("_before"))), "_part").withColumn(name, row + F.col("_before")).drop("_part", "_before")


def random_take(df: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    """n rows by a seeded hash of the key, all if there are no more."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def sample_links(links: DataFrame, blacklist: DataFrame, url: str = "url", seed: int = 1) -> DataFrame:
    """Distinct links not in the blacklist: max(4, n/10) of them."""
    own = links.select(url).distinct().join(blacklist.select(url).distinct(), url, "left_anti")
    n = own.count()
    return random_take(own, max(4, n // 10), url, seed)


def sample_decision(links: DataFrame, blacklist: DataFrame, url: str = "url", most: int = 20) -> DataFrame:
    """Up to `most` links not in the blacklist, in order."""
    return links.select(url).distinct().join(blacklist.select(url).distinct(), url, "left_anti").orderBy(url).limit(most)


def sample_proportional(items: DataFrame, score: str, u: float, order: str) -> DataFrame:
    """The first item, from the smallest score up, whose share of scores so far reaches u (from 0 to 1).

    Running sums go by cells of a fixed number of score ranges first, so that no task sorts all items.
    """
    spark = items.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = items.repartitionByRange(n, F.col(score), F.col(order)).withColumn("_part", F.spark_partition_id())
    by = materialize(by, "scores")
    part = by.groupBy("_part").agg(F.sum(score).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    part = part.select("_part", before.alias("_before"), F.sum("_s").over(Window.partitionBy(F.lit(1))).alias("_all"))
    running = F.sum(score).over(Window.partitionBy("_part").orderBy(score, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cum = by.join(part, "_part").withColumn("cumulative", (F.col("_before") + running) / F.col("_all"))
    return cum.filter(F.col("cumulative") >= u).orderBy("cumulative", score, order).limit(1).drop("_part", "_before", "_all")


def dequeue(queue: DataFrame, seq: str, head: bool) -> tuple[DataFrame, DataFrame]:
    """(item, rest): the first or last of a queue."""
    item = queue.orderBy(F.asc(seq) if head else F.desc(seq)).limit(1)
    return item, queue.join(item.select(seq), seq, "left_anti")


def cross_product(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def transpose(rows: DataFrame, key: str, values: str) -> DataFrame:
    """pos, values: the i-th values of all rows in the order of key, up to the shortest row."""
    short = rows.agg(F.min(F.size(values)).alias("_n"))
    at = rows.select(key, F.posexplode(values).alias("pos", "v")).crossJoin(F.broadcast(short)).filter("pos < _n")
    return at.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, "v"))), lambda x: x["v"]).alias("values"))


def subset_pairs(sets: DataFrame, key: str = "key", item: str = "item", by: tuple[str, ...] = ()) -> DataFrame:
    """small, large: keys (of one group `by`) whose items all are items of another key; by shared items, not all pairs."""
    own = sets.select(*by, key, item).distinct()
    n = own.groupBy(*by, key).agg(F.count("*").alias("_n"))
    x, y = own.select(*by, F.col(key).alias("small"), item), own.select(*by, F.col(key).alias("large"), item)
    shared = x.join(y, [*by, item]).filter("small <> large").groupBy(*by, "small", "large").agg(F.count("*").alias("_m"))
    return shared.join(n.withColumnRenamed(key, "small"), [*by, "small"]).filter("_m = _n").select(*by, "small", "large")

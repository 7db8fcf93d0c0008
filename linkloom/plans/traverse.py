"""Traversal of a page store, one level a step.

A link table stands for the pages: src, rank (of the decision), ord, xpath, href, text. Each level joins the frontier
to it; which of a page's decisions owns a link, what is sampled and what was visited are joins and windows. The order
of the queue is kept as an array that grows by (decision, link) with every level, so budgets cut exactly where a
queue would have stopped. The driver holds counters only; every level is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions.paths import action_at
from linkloom.operators.cluster import assign_online
from linkloom.operators.components import connected_components
from linkloom.operators.decisions import decide
from linkloom.operators.links import page_links, refined
from linkloom.operators.relational import numbered
from linkloom.operators.similarity import near_duplicate_pairs, similar_pairs, xpath_chars
from linkloom.sources.scratch import materialize

from .model import estimate_model

FRONTIER = "url string, path array<string>, src_url string, src_text string, seq array<long>"


@dataclass
class Stop:
    """Limits of a traversal; None: none. A custom test sees the counters."""

    visited: int | None = None
    leaves: int | None = None
    levels: int | None = None
    test: Callable[[dict], bool] | None = None

    def now(self, counters: dict) -> bool:
        over = lambda k: getattr(self, k) is not None and counters[k] >= getattr(self, k)
        return over("visited") or over("leaves") or over("levels") or bool(self.test and self.test(counters))


@dataclass
class Crawl:
    """visited: frontier columns and leaf, in the order of seq; model: path, n of the leaves; left: the queue's rest."""

    visited: DataFrame
    model: DataFrame
    left: DataFrame
    counters: dict


def link_table(pages: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    """src, rank, ord, xpath, href, text and steps (the link's path) of a page store (url, html)."""
    d = decide(page_links(pages, blacklist), steps=True)
    flat = d.select(F.col("page_url").alias("src"), "rank", "xpath", F.posexplode("hrefs_and_texts").alias("ord", "l"))
    return flat.select("src", "rank", "ord", "xpath", F.col("l.href").alias("href"), F.col("l.text").alias("text"), F.col("l.path").alias("steps"))


def seed(spark: SparkSession, url: str) -> DataFrame:
    return spark.createDataFrame([(url, [], None, None, [])], FRONTIER)


def seeds(starts: DataFrame) -> DataFrame:
    """Start rows of many pages (url)."""
    none = F.lit(None).cast("string")
    return starts.select("url", F.array().cast("array<string>").alias("path"), none.alias("src_url"), none.alias("src_text"), F.array().cast("array<bigint>").alias("seq"))


def claimed(links: DataFrame) -> DataFrame:
    """Links of each page kept by the first decision that has them."""
    w = Window.partitionBy("src", "href").orderBy("rank", "ord")
    return links.withColumn("_c", F.row_number().over(w)).filter("_c = 1").drop("_c")


def sampled(links: DataFrame, most: int | Column, seed: int = 1, by: tuple[str, ...] = ("src", "rank")) -> DataFrame:
    """Up to `most` links of each decision by a seeded hash; `_n` is their number before."""
    w = Window.partitionBy(*by)
    ranked = links.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.xxhash64("href", F.lit(seed)), "href")))
    return ranked.filter(F.col("_k") <= most).drop("_n", "_k")


def example_share(n: Column) -> Column:
    return F.greatest(F.lit(10), F.floor(n / 4))


def _expand(frontier: DataFrame, links: DataFrame, most: int | Column | None, seed_: int) -> DataFrame:
    own = claimed(links.join(frontier.select(F.col("url").alias("src")).distinct(), "src", "left_semi"))
    if most is not None:
        own = sampled(own, most, seed_)
    f = frontier.select(F.col("url").alias("src"), F.col("path").alias("_path"), F.col("seq").alias("_seq"))
    return own.join(f, "src").select(
        F.col("href").alias("url"),
        F.concat(F.array("xpath"), "_path").alias("path"),
        F.col("src").alias("src_url"),
        F.col("text").alias("src_text"),
        F.concat("_seq", F.array(F.col("rank").cast("long"), F.col("ord").cast("long"))).alias("seq"),
    )


def crawl(
    links: DataFrame,
    start: DataFrame,
    leaves: DataFrame | None = None,
    stop: Stop | None = None,
    per_decision: int | None = 10,
    order: str = "fifo",
    seed: int = 1,
    representatives: Callable[[DataFrame], DataFrame] | None = None,
) -> Crawl:
    """Breadth-first (order "fifo") or shuffled within levels ("random") traversal from `start` (see seed()).

    leaves: url of the pages that count as leaves. per_decision: links kept of each decision (None: all).
    representatives: a filter of the new links, such as one example a cluster.
    """
    stop = stop or Stop()
    name = materialize(start, "frontier")
    seen: DataFrame | None = None
    counters = {"visited": 0, "leaves": 0, "levels": 0, "queue": name.count()}
    while counters["queue"] and not stop.now(counters):
        key = F.col("seq") if order == "fifo" else F.xxhash64("url", F.lit(seed))
        level = name
        if stop.visited is not None:
            level = name.orderBy(key, "url").limit(stop.visited - counters["visited"])
        is_leaf = F.lit(False)
        if leaves is not None:
            level = level.join(leaves.select(F.col("url"), F.lit(True).alias("_leaf")).distinct(), "url", "left")
            is_leaf = F.coalesce("_leaf", F.lit(False))
        level = materialize(level.select("url", "path", "src_url", "src_text", "seq", is_leaf.alias("leaf")), "level")
        seen = level if seen is None else seen.unionByName(level)
        n = level.agg(F.count("*").alias("n"), F.count_if("leaf").alias("leaves")).first()
        counters["visited"] += n.n
        counters["leaves"] += n.leaves
        counters["levels"] += 1
        fresh = _expand(level, links, per_decision, seed)
        if representatives is not None:
            fresh = representatives(fresh)
        # A URL enters the queue once, by its first place, and never after it was visited or left waiting.
        first = fresh.groupBy("url").agg(F.min_by(F.struct("path", "src_url", "src_text", "seq"), "seq").alias("x")).select("url", "x.*")
        fresh = first.join(seen.select("url"), "url", "left_anti").join(name.select("url"), "url", "left_anti")
        waiting = name.join(level.select("url"), "url", "left_anti")
        name = materialize(waiting.unionByName(fresh) if stop.visited is not None else fresh, "frontier")
        counters["queue"] = name.count()
    if seen is None:
        seen = start.withColumn("leaf", F.lit(False)).limit(0)
    model = seen.filter("leaf").groupBy("path").agg(F.count("*").alias("n"))
    return Crawl(seen, model, name, counters)


def example_filter(pages: DataFrame, least: float = 0.8, seed: int = 1) -> Callable[[DataFrame], DataFrame]:
    """One example of each cluster of structurally similar pages among the links of a decision."""
    chars = materialize(xpath_chars(pages), "chars")

    def keep(fresh: DataFrame) -> DataFrame:
        own = materialize(fresh.withColumn("_d", F.concat_ws("\x01", "src_url", F.element_at("path", 1))), "fresh")
        x, y = own.select("_d", F.col("url").alias("a")), own.select("_d", F.col("url").alias("b"))
        # Pairs meet inside the bounded sample of one decision only.
        near = similar_pairs(chars, x.join(y, "_d").filter("a < b").select("a", "b"), least)
        comp = connected_components(near)
        grouped = own.join(comp.withColumnRenamed("id", "url"), "url", "left").withColumn("_g", F.coalesce("component", "url"))
        w = Window.partitionBy("_d", "_g").orderBy(F.xxhash64("url", F.lit(seed)), "url")
        return grouped.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("url", "path", "src_url", "src_text", "seq")

    return keep


def crawl_examples(pages: DataFrame, start: DataFrame, leaves: DataFrame | None = None, stop: Stop | None = None, seed: int = 1) -> Crawl:
    """Traversal of cluster representatives: a sample of max(10, n/4) of each decision, one example a cluster."""
    return crawl(link_table(pages), start, leaves, stop, example_share(F.col("_n")), "fifo", seed, example_filter(pages, seed=seed))


def leaf_edges(chars: DataFrame, leaves: DataFrame, least: float = 0.8) -> DataFrame:
    """a < b of structurally similar leaves (url); only pages that share a path are compared."""
    own = chars.join(leaves.select(F.col("url").alias("page_url")).distinct(), "page_url", "left_semi").select("page_url", "xpath")
    pairs = own.select(F.col("page_url").alias("a"), "xpath").join(own.select(F.col("page_url").alias("b"), "xpath"), "xpath").filter("a < b")
    return similar_pairs(chars, pairs.select("a", "b").distinct(), least).select("a", "b")


def crawl_with_estimation(
    pages: DataFrame, start: DataFrame, leaves: DataFrame | None = None, stop: Stop | None = None, seed: int = 1, least: float = 0.8
) -> tuple[Crawl, DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    """Crawls examples, clusters the leaves in the order they were met (clusters are never merged, the newest is asked
    first) and estimates the site's model: (crawl, clusters, (sequences, refinements, pagination))."""
    run = crawl_examples(pages, start, leaves, stop, seed)
    met = materialize(run.visited.filter("leaf"), "leaves")
    order = numbered(met.select(F.col("url").alias("id"), "seq"), [F.col("seq").asc(), F.col("id").asc()]).select("id", F.col("place").cast("long").alias("seq"))
    chars = materialize(xpath_chars(pages), "chars")
    clusters = assign_online(start.sparkSession.createDataFrame([], "id string, cluster long"), order, materialize(leaf_edges(chars, met, least), "edges"))
    corpus = run.visited.join(pages.select("url", F.col("html").alias("body")), "url", "left")
    return run, clusters, estimate_model(corpus, clusters)


def replay(
    links: DataFrame,
    start: DataFrame,
    actions: list[str],
    refinements: DataFrame | None = None,
    paging: DataFrame | None = None,
    budget: int | None = None,
    visited: DataFrame | None = None,
) -> Crawl:
    """Follows a model (newest action first) from `start`: at each place the next action's links, refined, and at most
    one paging link a page, that of the smallest whole number. Pages at the model's end are leaves.

    links: src, rank, ord, xpath, href, text and, for refinements (src_path, action, only, avoid), path as steps in
    `steps`. paging: src_path, paging_action. A paging link keeps its page's place. A page with a paging link text that
    is no number has no paging link.
    """
    goal = F.array(*(F.lit(a) for a in actions)).cast("array<string>")
    frontier = materialize(start, "frontier")
    seen, counters = None, {"visited": 0, "leaves": 0, "levels": 0, "queue": frontier.count()}
    while counters["queue"] and (budget is None or counters["visited"] < budget):
        level = frontier
        if budget is not None:
            level = frontier.orderBy("seq", "url").limit(budget - counters["visited"])
        level = materialize(level.withColumn("leaf", F.col("path") == goal), "level")
        seen = level if seen is None else seen.unionByName(level)
        n = level.agg(F.count("*").alias("n"), F.count_if("leaf").alias("l")).first()
        counters["visited"] += n.n
        counters["leaves"] += n.l
        counters["levels"] += 1
        at = level.select(F.col("url").alias("src"), F.col("path").alias("_path"), F.col("seq").alias("_seq"), action_at(goal, F.col("path")).alias("_next"))
        onward = links.join(at, "src").filter(F.col("xpath") == F.col("_next"))
        if refinements is not None:
            r = refinements.select(F.col("src_path").alias("_path"), F.col("action").alias("_next"), "only", "avoid")
            onward = onward.join(r, ["_path", "_next"], "left").filter(refined(F.col("steps"), F.col("only"), F.col("avoid")))
        pick = lambda df, path: df.select(
            F.col("href").alias("url"), path.alias("path"), F.col("src").alias("src_url"), F.col("text").alias("src_text"), F.concat("_seq", F.array(F.col("rank").cast("long"), F.col("ord").cast("long"))).alias("seq")
        )
        fresh = pick(onward, F.concat(F.array("xpath"), "_path"))
        if paging is not None:
            p = paging.select(F.col("src_path").alias("_path"), "paging_action")
            more = links.join(at, "src").join(p, "_path").filter(F.col("xpath") == F.col("paging_action"))
            w = Window.partitionBy("src")
            number = F.when(F.trim("text").rlike(r"^[0-9]{1,18}$"), F.trim("text").cast("long"))
            more = more.withColumn("_number", number).withColumn("_all", F.bool_and(F.col("_number").isNotNull()).over(w)).filter("_all")
            more = more.join(seen.select(F.col("url").alias("href")), "href", "left_anti")
            more = more.withColumn("_r", F.row_number().over(w.orderBy("_number", "href"))).filter("_r = 1")
            fresh = fresh.unionByName(pick(more, F.col("_path")))
        first = fresh.groupBy("url").agg(F.min_by(F.struct("path", "src_url", "src_text", "seq"), "seq").alias("x")).select("url", "x.*")
        fresh = first.join(seen.select("url"), "url", "left_anti")
        if visited is not None:
            fresh = fresh.join(visited.select("url"), "url", "left_anti")
        waiting = frontier.join(level.select("url"), "url", "left_anti")
        frontier = materialize(waiting.unionByName(fresh.join(waiting.select("url"), "url", "left_anti")), "frontier")
        counters["queue"] = frontier.count()
    if seen is None:
        seen = start.withColumn("leaf", F.lit(False)).limit(0)
    model = seen.filter("leaf").groupBy("path").agg(F.count("*").alias("n"))
    return Crawl(seen, model, frontier, counters)


def execute_plan(
    links: DataFrame,
    start: DataFrame,
    plan: list[list[str]],
    paging: DataFrame | None = None,
    budget: int | None = None,
    refinements: list[DataFrame] | None = None,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Runs the sequences in order with one shared budget; url, seq_no of the pages stored. A URL belongs to the first
    sequence that stored it. refinements: of each sequence (src_path, action, only, avoid). earlier: url of pages stored
    before this run, which are not visited again."""
    stored: DataFrame | None = None
    left = budget
    for i, actions in enumerate(plan):
        if left is not None and left <= 0:
            break
        run = replay(links, start, actions, refinements[i] if refinements else None, paging, left, earlier)
        left = None if left is None else left - run.counters["visited"]
        own = run.visited.filter("leaf").select("url", F.lit(i).alias("seq_no"))
        stored = own if stored is None else stored.unionByName(own)
    if stored is None:
        return start.select("url", F.lit(0).alias("seq_no")).limit(0)
    return stored.groupBy("url").agg(F.min("seq_no").alias("seq_no"))


def consecutive_duplicates(stored: DataFrame, pages: DataFrame, order: str = "seq") -> DataFrame:
    """url, seen and run: how many near duplicates of earlier pages end at each stored page, in order."""
    text = stored.join(pages.select("url", "html"), "url").select("url", "html", order)
    pairs = near_duplicate_pairs(text, key="url", text="html")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    when = text.select("url", order)
    hit = both.join(when.select(F.col("url").alias("a"), F.col(order).alias("_x")), "a").join(when.select(F.col("url").alias("b"), F.col(order).alias("_y")), "b").filter("_y < _x").select(F.col("a").alias("url"), F.lit(True).alias("_s")).distinct()
    flagged = when.join(hit, "url", "left").withColumn("seen", F.coalesce("_s", F.lit(False)))
    grp = F.sum((~F.col("seen")).cast("int")).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    flagged = flagged.withColumn("_g", grp)
    run = F.sum(F.col("seen").cast("int")).over(Window.partitionBy("_g").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return flagged.select("url", "seen", run.alias("run"))

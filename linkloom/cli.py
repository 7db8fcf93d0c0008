"""Command line: learn a site's model from a page store, replay it, or crawl it."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.classify import FEATURES, is_leaf, leaf_features, load_linear_model
from linkloom.operators.similarity import like_example, xpath_chars
from linkloom.plans import model as M
from linkloom.plans import traverse as X
from linkloom.sources.tables import dump_run, exists, read_lines, read_table

log = logging.getLogger("linkloom")


def say(*parts: object) -> str:
    """Logs parts as one line, which it returns."""
    line = " ".join(map(str, parts))
    log.info(line)
    return line


def log_to(path: str | None = None, level: int = logging.INFO) -> None:
    """Sends the package's log to a file of the driver, or to the standard error stream; replaces an earlier choice."""
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    h = logging.FileHandler(path) if path else logging.StreamHandler()
    h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(h)
    log.setLevel(level)


def leaves_of(pages: DataFrame, example: str | None, classifier: str | None) -> DataFrame:
    """url of the pages that are like an example page, or that a linear model takes for leaves (the stored one if none is
    named)."""
    spark = pages.sparkSession
    if example:
        chars = xpath_chars(pages)
        like = like_example(chars, chars.filter(F.col("page_url") == example))
        return like.filter("leaf").select(F.col("page_url").alias("url"))
    names = [F.col(f).cast("double") for f in FEATURES]
    leaf = is_leaf(names, *load_linear_model(spark, classifier)) if classifier else is_leaf(names)
    return leaf_features(pages).filter(F.coalesce(leaf, F.lit(False))).select(F.col("page_url").alias("url"))


def _bodies(visited: DataFrame, pages: DataFrame) -> DataFrame:
    return visited.join(pages.withColumnRenamed("html", "body"), "url", "left").select("url", "body", "src_url", "src_text", "path", "leaf")


def learn(pages: DataFrame, start: DataFrame, leaf: DataFrame, mode: str, num_leaves: int, out: str) -> str:
    """Crawls and writes state, corpus, model paths, model, refinements and paging; the folder's path.

    discussion-forum: crawls examples and takes the model from the largest cluster of leaves, which is written as well.
    """
    stop = X.Stop(visited=num_leaves) if mode == "structure-driven" else X.Stop(leaves=num_leaves)
    if mode == "discussion-forum":
        run, clusters, (sequences, refinements, paging) = X.crawl_with_estimation(pages, start, leaf, stop)
        more = {"clusters": clusters.select(F.col("cluster").cast("string").alias("cluster"), "id")}
        corpus = _bodies(run.visited, pages)
    else:
        run, more = X.crawl(X.link_table(pages), start, leaf, stop, order="random" if mode == "crawl-random" else "fifo"), {}
        corpus = _bodies(run.visited, pages)
        sequences = run.model.select(F.xxhash64(F.to_json("path")).alias("seq_id"), F.col("path").alias("actions"))
        refinements, paging = M.refine_action_seq(corpus, sequences), M.detect_pagination(corpus)
    say(mode, "visited", run.counters["visited"], "leaves", run.counters["leaves"], "queue", run.counters["queue"])
    tables = {
        "state": run.left,
        "corpus": corpus,
        "model_paths": run.model,
        "model": sequences.select("seq_id", "actions"),
        "refinements": refinements.select("seq_id", "src_path", "action", "only", "avoid"),
        "paging": paging.select("src_path", "paging_action", "sim", "only", "avoid"),
    }
    return dump_run(out, tables | more)


def execute(pages: DataFrame, start: DataFrame, model: str, out: str, budget: int | None = None, stored: DataFrame | None = None) -> str:
    """Replays a model that learn() wrote: pagination is taken out of it, avoid lists are probed again on the stored pages,
    sequences run in the order of their plan with their refinements, and the pages found are written.

    budget: pages visited by all sequences together. stored: url of pages of an earlier run, which are not stored again.
    """
    spark = pages.sparkSession
    t = lambda name, kind: read_table(spark, f"{model}/{name}", kind)
    sequences, paging, docs, refinements = t("model", "model_actions"), t("paging", "paging"), t("corpus", "corpus"), t("refinements", "model_refinements")
    kept, fixed = M.fix_model(sequences, refinements, paging, M.probe_restrictions(docs, sequences, refinements))
    links = X.link_table(pages)
    n = links.groupBy(F.col("src").alias("url"), F.col("xpath").alias("action")).agg(F.count("*").alias("n"))
    plan = M.plan_model(kept, M.estimate_yield(kept, docs, n, paging))
    # A site's plan is a handful of sequences; they are run one after another.
    order = [(r.seq_id, r.actions) for r in plan.orderBy("place").select("seq_id", "actions").toLocalIterator()]
    done = X.execute_plan(links, start, [a for _, a in order], paging, budget, [fixed.filter(F.col("seq_id") == s) for s, _ in order], stored)
    say("executed", len(order), "sequences of", model)
    return dump_run(out, {"corpus": done.join(pages.withColumnRenamed("html", "body"), "url", "left"), "plan": plan})


def crawl_sites(spark: SparkSession, list_path: str, pages: DataFrame, leaf: DataFrame, num_leaves: int, out: str) -> DataFrame:
    """Crawls many sites in one traversal: every line of a file is an entry page. Writes one corpus, with the entry each
    page was reached from (column site), and returns the entries that the store has not."""
    starts = read_lines(spark, list_path).select(F.trim("value").alias("url")).filter("url <> ''").distinct()
    found = starts.join(pages.select("url").distinct(), "url", "left_semi")
    run = X.crawl(X.link_table(pages), X.seeds(found), leaf, X.Stop(leaves=num_leaves), 10)
    site = F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0)
    dump_run(out, {"corpus": _bodies(run.visited, pages).withColumn("site", site)})
    return starts.join(found, "url", "left_anti")


def main(argv: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("mode", choices=("structure-driven", "discussion-forum", "crawl-random", "execute", "execute-budget"))
    p.add_argument("--pages", required=True, help="page store: parquet of url, html")
    p.add_argument("--start", required=True)
    p.add_argument("--example", help="URL of an example leaf page")
    p.add_argument("--classifier", help="linear model in libsvm's text format; the stored one if neither is given")
    p.add_argument("--model", help="folder that an earlier run wrote")
    p.add_argument("--stored", help="parquet of url: pages of an earlier run, not stored again")
    p.add_argument("--num-leaves", type=int, default=300)
    p.add_argument("--budget", type=int, default=1000)
    p.add_argument("--out", default="runs")
    p.add_argument("--log", help="file for the log")
    a = p.parse_args(argv)
    if a.log:
        log_to(a.log)
    spark = SparkSession.builder.getOrCreate()
    pages = spark.read.parquet(a.pages).select("url", "html")
    start = X.seed(spark, a.start)
    if a.mode in ("execute", "execute-budget"):
        if not a.model or not exists(spark, a.model):
            p.error("--model must name a folder that an earlier run wrote")
        stored = spark.read.parquet(a.stored).select("url") if a.stored else None
        return execute(pages, start, a.model, a.out, a.budget if a.mode == "execute-budget" else None, stored)
    return learn(pages, start, leaves_of(pages, a.example, a.classifier), a.mode, a.num_leaves, a.out)


if __name__ == "__main__":
    print(main())

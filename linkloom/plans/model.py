"""Navigation models: pagination, refinements, yield and plans, from a corpus table.

corpus: url, body, src_url, src_text, path array<string> (newest action first, empty at the entry), leaf boolean.
Paths are compared as arrays; the root is the empty array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.paths import action_at, model_steps, source_path
from linkloom.operators.decisions import decide
from linkloom.operators.links import REFINEMENT, eval_refined, matches, page_links, refine_accuracy
from linkloom.operators.relational import numbered
from linkloom.operators.similarity import structural_similarity, xpath_chars
from linkloom.sources.scratch import materialize


def _chars(corpus: DataFrame) -> DataFrame:
    return xpath_chars(corpus.select("url", F.col("body").alias("html")))


def source_similarity(corpus: DataFrame) -> DataFrame:
    """a (page), b (its source) and sim, for pages whose source is in the corpus."""
    pairs = corpus.join(corpus.select(F.col("url").alias("src_url")), "src_url").select(F.col("url").alias("a"), F.col("src_url").alias("b"))
    return structural_similarity(_chars(corpus), pairs)


def pagination_candidates(corpus: DataFrame, sims: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """url, src_path, action, sim of pages like their source. sims: a, b, sim (worked out from the bodies if absent)."""
    sims = source_similarity(corpus) if sims is None else sims
    near = sims.filter(F.col("sim") >= least)
    own = corpus.join(near, (corpus["url"] == near["a"]) & (corpus["src_url"] == near["b"]))
    return own.filter(F.size("path") > 0).select("url", "src_url", "src_text", source_path(F.col("path")).alias("src_path"), F.col("path")[0].alias("action"), "sim")


def pagination_in_corpus(candidates: DataFrame) -> DataFrame:
    """src_path and its paging actions: candidates that do not merely follow another candidate's action."""
    c = candidates.groupBy("src_path", "action").agg(F.count("*").alias("n"))
    follow = c.select(F.concat(F.array("action"), "src_path").alias("src_path")).distinct()
    return c.join(follow, "src_path", "left_anti").groupBy("src_path").agg(F.array_sort(F.collect_list("action")).alias("actions"))


def paging_actions(candidates: DataFrame) -> DataFrame:
    """src_path, paging_action, sim: of pages reached by a number, the action most like its source; ties to the smaller."""
    digits = candidates.filter(F.col("src_text").rlike(r"^[0-9]+$"))
    w = Window.partitionBy("src_path").orderBy(F.desc("sim"), "action")
    return digits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("src_path", F.col("action").alias("paging_action"), "sim")


def most_frequent(values: DataFrame, by: tuple[str, ...], value: tuple[str, ...]) -> DataFrame:
    """The most frequent combination of `value` for each `by`, nulls included; ties to the smaller as JSON."""
    n = values.groupBy(*by, *value).agg(F.count("*").alias("_n")).withColumn("_j", F.to_json(F.struct(*value)))
    w = Window.partitionBy(*by).orderBy(F.desc("_n"), "_j")
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*by, *value)


def detect_pagination(corpus: DataFrame, sims: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """src_path, paging_action, sim, only, avoid: paging actions with the refinement that most sources agree on."""
    sims = source_similarity(corpus) if sims is None else sims
    best = paging_actions(pagination_candidates(corpus, sims, least))
    full = best.withColumn("full", F.concat(F.array("paging_action"), "src_path"))
    docs = corpus.join(full, corpus["path"] == full["full"]).select("url", "src_url", "src_path", "paging_action")
    judged = docs.join(sims, (docs["url"] == sims["a"]) & (docs["src_url"] == sims["b"]), "left")
    labels = judged.select(F.col("src_url").alias("page_url"), F.col("url").alias("href"), "src_path", F.col("paging_action").alias("xpath"), F.coalesce(F.col("sim") >= least, F.lit(False)).alias("muscle"))
    ref = _refinements(corpus, labels, ("src_path",))
    chosen = most_frequent(ref, ("src_path", "xpath"), ("only", "avoid")).withColumnRenamed("xpath", "paging_action")
    return best.join(chosen, ["src_path", "paging_action"], "left")


def _refinements(corpus: DataFrame, labels: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    """Learned only and avoid by source page, action and `extra`. labels: page_url, href, xpath, muscle and extra."""
    sources = corpus.join(labels.select(F.col("page_url").alias("url")).distinct(), "url", "left_semi").select("url", F.col("body").alias("html"))
    links = page_links(sources).join(labels.select("page_url", "xpath", *extra).distinct(), ["page_url", "xpath"])
    # The labels of one place on the way must not meet those of another, so they are keyed by it.
    tag = F.to_json(F.struct(*extra)) if extra else F.lit("")
    links = links.withColumn("page_url", F.concat_ws("\x01", "page_url", tag))
    marks = labels.withColumn("page_url", F.concat_ws("\x01", "page_url", tag))
    return refine_accuracy(links, marks.select("page_url", "href", "muscle"), ("page_url", "xpath", *extra))


def shows_action(corpus: DataFrame) -> DataFrame:
    """url, xpath of every decision of every page in the corpus."""
    return decide(page_links(corpus.select("url", F.col("body").alias("html")))).select(F.col("page_url").alias("url"), "xpath")


def refine_action_seq(corpus: DataFrame, sequences: DataFrame) -> DataFrame:
    """seq_id, src_path, action, only, avoid for every place on the way of each sequence (seq_id, actions).

    Pages at a place are muscle when they show the next action, at the end when they are leaves; each source page
    teaches a refinement and the most frequent one is kept.
    """
    steps = sequences.select("seq_id", "actions", F.explode(model_steps(F.col("actions"))).alias("step")).filter(F.size("step") > 0)
    steps = steps.withColumn("next", action_at(F.col("actions"), F.col("step")))
    docs = corpus.select("url", "src_url", "path", "leaf").join(steps, F.col("path") == F.col("step"))
    shown = shows_action(corpus).select(F.col("url"), F.col("xpath").alias("next"), F.lit(True).alias("_shown")).distinct()
    docs = docs.join(shown, ["url", "next"], "left")
    muscle = F.when(F.col("next").isNull(), F.coalesce("leaf", F.lit(False))).otherwise(F.coalesce("_shown", F.lit(False)))
    labels = docs.select("seq_id", F.col("src_url").alias("page_url"), F.col("url").alias("href"), F.col("step")[0].alias("xpath"), source_path(F.col("step")).alias("src_path"), muscle.alias("muscle")).filter("page_url is not null")
    ref = _refinements(corpus, labels, ("seq_id", "src_path"))
    return most_frequent(ref, ("seq_id", "src_path", "xpath"), ("only", "avoid")).withColumnRenamed("xpath", "action")


def step_links(links: DataFrame, refinements: DataFrame | None = None) -> DataFrame:
    """n_links by page_url and xpath (distinct links), refined where refinements (xpath, only, avoid) say so."""
    if refinements is not None:
        plain = links.join(refinements.select("xpath").distinct(), "xpath", "left_anti")
        links = plain.unionByName(eval_refined(links, refinements).select(*plain.columns))
    return links.groupBy("page_url", "xpath").agg(F.count_distinct("href", "text").alias("n_links"))


def estimate_yield(sequences: DataFrame, docs: DataFrame, n_links: DataFrame, paging: DataFrame | None = None, longest: int | None = None, boost: int = 10) -> DataFrame:
    """seq_id, yield of each sequence (seq_id, actions).

    docs: url, src_url, path, leaf. n_links: url, action, n (links of a page at an action). From the leaves at the
    sequence's end back to the entry, only pages that were sources of the step after count; a step's factor is the
    largest n of its pages at the next action, times `boost` where the place has pagination (paging: src_path); no page
    makes it 0. Ancestors are found by doubling, so the rounds grow with the logarithm of the longest sequence; pages go
    by a number there, not by address and path.
    """
    if longest is None:
        longest = sequences.agg(F.max(F.size("actions"))).first()[0] or 0
    own = docs.filter("url is not null and path is not null").groupBy("url", "path").agg(F.bool_or("leaf").alias("leaf"), F.collect_set("src_url").alias("src"))
    pages = materialize(own.withColumn("id", F.monotonically_increasing_id()), "pages")
    below = pages.filter(F.size("path") > 0).select("id", F.explode("src").alias("src"), source_path(F.col("path")).alias("at"))
    above = pages.select(F.col("id").alias("up"), "url", "path")
    hop = materialize(below.join(above, (F.col("src") == F.col("url")) & (F.col("at") == F.col("path"))).select("id", "up"), "hops")
    reach = materialize(sequences.join(pages.filter("leaf").select("id", "path"), F.col("actions") == F.col("path")).select("seq_id", "id").distinct(), "reach")
    span = 1
    while span <= longest:
        further = reach.join(hop, "id").select("seq_id", F.col("up").alias("id"))
        reach, span = materialize(reach.unionByName(further).distinct(), "reach"), 2 * span
        if span <= longest:
            hop = materialize(hop.withColumnRenamed("up", "_via").join(hop.withColumnRenamed("id", "_via"), "_via").select("id", "up").distinct(), "hops")
    # A page that is reached has the last k of the sequence's actions as its path.
    met = reach.join(pages.select("id", "url", F.size("path").alias("k")), "id").join(sequences.select("seq_id", "actions"), "seq_id").filter(F.col("k") < F.size("actions"))
    met = met.withColumn("action", F.get(F.reverse("actions"), F.col("k")))
    best = met.join(n_links.select("url", "action", "n"), ["url", "action"], "left").groupBy("seq_id", "k").agg(F.max(F.coalesce("n", F.lit(0))).alias("best"))
    steps = sequences.select("seq_id", F.size("actions").alias("len"), F.posexplode(model_steps(F.col("actions"))).alias("k", "step"))
    if paging is not None:
        steps = steps.join(paging.select(F.col("src_path").alias("step"), F.lit(boost).alias("boost")).distinct(), "step", "left")
    else:
        steps = steps.withColumn("boost", F.lit(None).cast("int"))
    factor = F.when(F.col("k") == F.col("len"), F.lit(1)).otherwise(F.coalesce("best", F.lit(0))) * F.coalesce("boost", F.lit(1))
    factors = steps.join(best, ["seq_id", "k"], "left").groupBy("seq_id").agg(F.collect_list(factor.cast("long")).alias("f"))
    return factors.select("seq_id", F.aggregate("f", F.lit(1).cast("long"), lambda a, x: a * x).alias("yield"))


def plan_model(sequences: DataFrame, yields: DataFrame | None = None) -> DataFrame:
    """Sequences with place, from 1: by length, then largest yield (column n or the yields table), then actions."""
    own = sequences if yields is None else sequences.join(yields.select("seq_id", F.col("yield").alias("n")), "seq_id", "left")
    return numbered(own, [F.size("actions").asc(), F.col("n").desc(), F.col("actions").asc()])


def remove_pagination(sequences: DataFrame, refinements: DataFrame, paging: DataFrame) -> DataFrame:
    """Sequences that do not begin with a paging action under the same refinement. refinements: seq_id, src_path,
    action, only, avoid; paging: src_path, paging_action, only, avoid."""
    danger = paging.select(F.concat(F.array("paging_action"), "src_path").alias("danger"), F.col("only").alias("po"), F.col("avoid").alias("pa"))
    own = sequences.withColumn("src_path", source_path(F.col("actions"))).withColumn("action", F.get("actions", F.lit(0))).join(refinements.select("seq_id", "src_path", "action", "only", "avoid"), ["seq_id", "src_path", "action"], "left")
    begins = F.slice("actions", F.size("actions") - F.size("danger") + 1, F.size("danger")) == F.col("danger")
    # The start of the way (its last actions) is the join key: any place on it may be a paging one.
    way = own.withColumn("danger", F.explode(model_steps(F.col("actions"))))
    bad = way.join(danger, "danger").filter(begins & F.col("only").eqNullSafe(F.col("po")) & F.col("avoid").eqNullSafe(F.col("pa")))
    return sequences.join(bad.select("seq_id").distinct(), "seq_id", "left_anti")


def leaf_paths(clusters: DataFrame, corpus: DataFrame) -> DataFrame:
    """Distinct paths of the pages of the largest leaf cluster (id, cluster); ties to the smallest cluster."""
    top = clusters.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(1)
    return corpus.join(clusters.join(top, "cluster", "left_semi").select(F.col("id").alias("url")), "url", "left_semi").select("path").distinct()


def path_frequencies(docs: DataFrame) -> DataFrame:
    return docs.groupBy("path").agg(F.count("*").alias("n"))


def estimate_model(corpus: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sequences, refinements, pagination) of a site."""
    paths = leaf_paths(clusters, corpus).withColumnRenamed("path", "actions")
    sequences = paths.withColumn("seq_id", F.xxhash64(F.to_json("actions")))
    return sequences, refine_action_seq(corpus, sequences), detect_pagination(corpus)


def fix_restrictions(refinements: DataFrame, probes: DataFrame) -> DataFrame:
    """Refinements with avoid replaced by the most frequent probe result (seq_id, src_path, action, avoid)."""
    best = most_frequent(probes, ("seq_id", "src_path", "action"), ("avoid",)).withColumnRenamed("avoid", "_avoid")
    return refinements.join(best, ["seq_id", "src_path", "action"], "left").withColumn("avoid", F.coalesce("_avoid", "avoid")).drop("_avoid")


def probe_restrictions(corpus: DataFrame, sequences: DataFrame, refinements: DataFrame, sample: int = 10, seed: int = 1) -> DataFrame:
    """seq_id, src_path, action, avoid as each source page of the corpus would have it: an avoid pair goes where one of up
    to `sample` links that it shuts out leads to a page that goes on (shows the sequence's next action, or is a leaf at
    its end). Links whose page the corpus has not prove nothing."""
    keys = ["seq_id", "src_path", "action", "page_url"]
    ref = refinements.filter(F.size("avoid") > 0).select("seq_id", "src_path", "action", "avoid").join(sequences.select("seq_id", "actions"), "seq_id")
    sources = corpus.join(ref.select(F.col("src_path").alias("path")).distinct(), "path", "left_semi")
    at = sources.select(F.col("path").alias("src_path"), F.col("url").alias("page_url")).join(ref, "src_path")
    pair = at.select(*keys, "actions", F.explode("avoid").alias("pair")).withColumn("_pair", F.to_json("pair"))
    own = page_links(sources.select("url", F.col("body").alias("html"))).select("page_url", F.col("xpath").alias("action"), "path", "href")
    shut = own.join(pair, ["page_url", "action"]).filter(matches(F.col("path"), F.col("pair")))
    w = Window.partitionBy(*keys, "_pair").orderBy(F.xxhash64("href", F.lit(seed)), "href")
    few = shut.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample)
    few = few.withColumn("next", action_at(F.col("actions"), F.concat(F.array("action"), "src_path")))
    shown = shows_action(corpus).select(F.col("url").alias("href"), F.col("xpath").alias("next"), F.lit(True).alias("_shown")).distinct()
    leaf = corpus.groupBy(F.col("url").alias("href")).agg(F.bool_or("leaf").alias("_leaf"))
    judged = few.join(shown, ["href", "next"], "left").join(leaf, "href", "left")
    good = F.when(F.col("next").isNull(), F.coalesce("_leaf", F.lit(False))).otherwise(F.coalesce("_shown", F.lit(False)))
    bad = judged.filter(good).select(*keys, "_pair").distinct()
    kept = pair.join(bad, [*keys, "_pair"], "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_list("pair")).alias("avoid"))
    none = F.array().cast(REFINEMENT)
    return at.select(*keys).distinct().join(kept, keys, "left").select("seq_id", "src_path", "action", F.coalesce("avoid", none).alias("avoid"))


def like_most(pages: DataFrame, cluster: DataFrame, sims: DataFrame, least: float = 0.8) -> DataFrame:
    """url, leaf: like at least half of a cluster's members. sims: a (page), b (member), sim."""
    n = cluster.count()
    hits = sims.join(cluster.select(F.col("id").alias("b")), "b", "left_semi").filter(F.col("sim") >= least).groupBy(F.col("a").alias("url")).agg(F.count("*").alias("_n"))
    return pages.select("url").join(hits, "url", "left").select("url", (F.coalesce("_n", F.lit(0)) * 2 >= n).alias("leaf"))


def fix_model(sequences: DataFrame, refinements: DataFrame, paging: DataFrame, probes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pagination taken out of the sequences, and refinements probed again."""
    kept = remove_pagination(sequences, refinements, paging)
    ref = refinements.join(kept.select("seq_id"), "seq_id", "left_semi")
    return kept, ref if probes is None else fix_restrictions(ref, probes)


def pick_pagination(candidates: DataFrame) -> DataFrame:
    """First candidate by anchor text of each source path."""
    w = Window.partitionBy("src_path").orderBy("src_text", "url")
    return candidates.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def deepest_pagination(candidates: DataFrame, src_url: str | None = None) -> DataFrame:
    """The first candidate of the deepest source path (of one source page, if given)."""
    own = candidates if src_url is None else candidates.filter(F.col("src_url") == src_url)
    return pick_pagination(own).orderBy(F.desc(F.size("src_path")), "src_text", "url").limit(1)

"""Pages to scored decisions: each action of a page with its links, ranked.

The links of one page fit one row, so dedup and subset pruning of decisions happen inside it, in native higher-order
functions; one aggregation by page is the only shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.paths import action_at
from linkloom.functions.text import host, tokenize, tokenize_url

from linkloom.sources.scratch import materialize

from .links import eval_refined, page_links


def without_templates(links: DataFrame, templates: DataFrame | None) -> DataFrame:
    """Links that are not template links (xpath, href) of the page's site."""
    if templates is None:
        return links
    on = [c for c in ("page_url", "xpath", "href") if c in templates.columns]
    return links.join(templates.select(*on).distinct(), on, "left_anti")


def remove_subsets(decisions: Column) -> Column:
    """Of an array of structs with xpath and hrefs (sorted sets): one of each href set (the smallest xpath), and none
    whose set lies within another's."""
    one = F.filter(decisions, lambda a: ~F.exists(decisions, lambda b: (b["hrefs"] == a["hrefs"]) & (b["xpath"] < a["xpath"])))
    inside = lambda a, b: (F.size(a["hrefs"]) < F.size(b["hrefs"])) & (F.size(F.array_except(a["hrefs"], b["hrefs"])) == 0)
    return F.filter(one, lambda a: ~F.exists(decisions, lambda b: inside(a, b)))


def decide(links: DataFrame, score: str = "count", steps: bool = False) -> DataFrame:
    """page_url, xpath, score, hrefs_and_texts and rank (from 1) from a link table.

    Links count once by address and text. score: their number ("count") or the characters of their texts ("chars").
    Actions without score go, and so do those that repeat another's addresses or a part of them. steps: links carry their
    path as well.
    """
    return _ranked(_acts(links, steps), score)


def _acts(links: DataFrame, steps: bool = False) -> DataFrame:
    """page_url, xpath, n (links by address and text), distinct_chars, chars (repeats counted), hrefs, hrefs_and_texts."""
    # One exchange: what is dealt by page is dealt by any key that holds the page.
    more = ["path"] if steps else []
    links = links.select("page_url", "xpath", "href", "text", "ord", "n_chars", *more).repartition("page_url")
    once = links.groupBy("page_url", "xpath", "href", "text").agg(F.min("ord").alias("ord"), F.first("n_chars").alias("n_chars"), F.sum("n_chars").alias("_all"), *(F.min_by(c, "ord").alias(c) for c in more))
    return once.groupBy("page_url", "xpath").agg(
        F.count("*").alias("n"),
        F.sum("n_chars").alias("distinct_chars"),
        F.sum("_all").alias("chars"),
        F.array_sort(F.collect_set("href")).alias("hrefs"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "href", "text", *more))), lambda x: F.struct(*(x[c].alias(c) for c in ("href", "text", *more)))).alias("hrefs_and_texts"),
    )


def _ranked(acts: DataFrame, score: str) -> DataFrame:
    acts = acts.withColumn("score", F.col("n" if score == "count" else "distinct_chars"))
    pages = acts.filter("score > 0").groupBy("page_url").agg(F.collect_list(F.struct("xpath", "hrefs", "score", "hrefs_and_texts")).alias("d"))
    kept = pages.withColumn("d", remove_subsets(F.col("d")))
    order = lambda x: F.struct((-x["score"]).alias("o"), x["xpath"].alias("xpath"), x["score"].alias("score"), x["hrefs_and_texts"].alias("hrefs_and_texts"))
    ranked = kept.select("page_url", F.posexplode(F.array_sort(F.transform("d", order))).alias("rank", "x"))
    return ranked.select("page_url", F.col("x.xpath").alias("xpath"), F.col("x.score").alias("score"), F.col("x.hrefs_and_texts").alias("hrefs_and_texts"), (F.col("rank") + 1).alias("rank"))


def state_action(pages: DataFrame, templates: DataFrame | None = None, blacklist: DataFrame | None = None, html: str = "html", url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(decisions, page_nav): the ranked decisions of each page, and page_url, total_nav_info: characters of all its
    links' texts, repeats counted. A page without text or links has none."""
    links = without_templates(page_links(pages, blacklist, html, url), templates)
    # Both come out of one table of the pages' link texts, so pages are parsed once.
    both = materialize(_acts(links), "actions")
    nav = both.groupBy("page_url").agg(F.sum("chars").alias("total_nav_info"))
    return _ranked(both, "count"), nav


def state_action_refined(pages: DataFrame, refinements: DataFrame, templates: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """Decisions of one action a page, refined. refinements: xpath, only, avoid, and page_url if they differ by page."""
    links = without_templates(eval_refined(page_links(pages, blacklist), refinements), templates)
    return decide(links)


def state_action_model(frontier: DataFrame, actions: list[str], blacklist: DataFrame | None = None) -> DataFrame:
    """Decisions at the next action of a model (newest first) for pages with html, url and path; scored by characters.
    Pages at the model's end have none."""
    seq = F.array(*(F.lit(a) for a in actions))
    links = page_links(frontier, blacklist, keep=("path",)) if "path" not in frontier.columns else page_links(frontier.withColumnRenamed("path", "at"), blacklist, keep=("at",))
    return decide(links.filter(F.col("xpath") == action_at(seq, F.col("at"))), "chars")


def state_action_sampled(pages: DataFrame, most: int = 10) -> DataFrame:
    """Decisions with their first `most` links."""
    decisions, _ = state_action(pages)
    return decisions.withColumn("hrefs_and_texts", F.slice("hrefs_and_texts", 1, most))


def template_links(decisions: DataFrame, fetched: DataFrame, per_action: int = 2, least: int = 5) -> DataFrame:
    """Template links of pages: page_url, xpath, href, n.

    Of each decision the first `per_action` links not taken by an earlier one are looked at. fetched: the decisions of
    those pages (page_url, xpath, hrefs_and_texts). An action's incidence is the number of decisions that saw it in
    their samples (the last sample of a decision counts); from `least` on, links that `least` of these show are
    template links.
    """
    link = decisions.select("page_url", "rank", "xpath", F.posexplode("hrefs_and_texts").alias("at", "l")).select("page_url", "rank", "xpath", "at", F.col("l.href").alias("href"))
    first = Window.partitionBy("page_url", "href").orderBy("rank", "at")
    mine = link.withColumn("_f", F.row_number().over(first)).filter("_f = 1 and href <> page_url")
    pick = Window.partitionBy("page_url", "rank").orderBy("at")
    picked = mine.withColumn("_k", F.row_number().over(pick)).filter(F.col("_k") <= per_action)
    seen = picked.select(F.col("page_url").alias("src"), "rank", F.col("_k").alias("k"), "href").join(
        fetched.select(F.col("page_url").alias("href"), F.col("xpath").alias("seen_xpath"), F.col("hrefs_and_texts.href").alias("hrefs")), "href"
    )
    obs = seen.groupBy("src", "rank", "seen_xpath").agg(F.max_by("hrefs", "k").alias("hrefs"))
    often = obs.groupBy("src", "seen_xpath").agg(F.count("*").alias("incidence")).filter(F.col("incidence") >= least)
    shown = obs.join(often, ["src", "seen_xpath"]).select(F.col("src").alias("page_url"), F.col("seen_xpath").alias("xpath"), "rank", F.explode(F.array_distinct("hrefs")).alias("href"))
    counts = shown.groupBy("page_url", "xpath", "href").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counts.join(link.select("page_url", "xpath", "href").distinct(), ["page_url", "xpath", "href"], "left_semi")


# ------------------------------------------------------------------ token-scored variant


def host_links(pages: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    """Links on the page's host or without a host, with url_tokens and text_tokens (sets)."""
    links = page_links(pages, blacklist)
    links = links.filter(host(F.col("href")).isNull() | (host(F.col("href")) == host(F.col("page_url"))))
    return links.withColumn("url_tokens", F.array_distinct(tokenize_url(F.col("href")))).withColumn("text_tokens", F.array_distinct(tokenize(F.col("text"))))


def token_scores(links: DataFrame, by: tuple[str, ...] = ("page_url", "xpath")) -> DataFrame:
    """score of each group: mean times population variance of the links' token numbers."""
    n = F.size(F.array_union("url_tokens", "text_tokens"))
    return links.withColumn("_c", n).groupBy(*by).agg((F.avg("_c") * F.var_pop("_c")).alias("score"), F.count("*").alias("n_links"))


def richest(scores: DataFrame, page: str = "page_url") -> DataFrame:
    """The best-scored action of each page; ties to the smaller xpath."""
    w = Window.partitionBy(page).orderBy(F.desc("score"), "xpath")
    return scores.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def above_average(scores: DataFrame, page: str = "page_url") -> DataFrame:
    """Actions scored at least the page's mean, with page_score: the mean of the chosen."""
    own = scores.withColumn("_mean", F.avg("score").over(Window.partitionBy(page))).filter("score >= _mean").drop("_mean")
    return own.withColumn("page_score", F.avg("score").over(Window.partitionBy(page)))


def below_average(scores: DataFrame, page: str = "page_url") -> DataFrame:
    return scores.withColumn("_mean", F.avg("score").over(Window.partitionBy(page))).filter("score < _mean").drop("_mean")


def explore_order(links: DataFrame, scores: DataFrame, most: int = 20, blacklist: DataFrame | None = None) -> DataFrame:
    """Actions from the weakest up, each with at most `most` distinct links that are not in the blacklist."""
    own = links.select("page_url", "xpath", "href", "ord").groupBy("page_url", "xpath", "href").agg(F.min("ord").alias("ord"))
    if blacklist is not None:
        own = own.join(blacklist.select(F.col("url").alias("href")).distinct(), "href", "left_anti")
    w = Window.partitionBy("page_url", "xpath").orderBy("ord")
    few = own.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)
    place = Window.partitionBy("page_url").orderBy("score", "xpath")
    return few.join(scores.withColumn("place", F.row_number().over(place)), ["page_url", "xpath"]).select("page_url", "place", "xpath", "score", "k", "href")


def is_weak_leaf(total: Column, decisions: Column, score: Column, factor: float = 0.75) -> Column:
    """Whether a page scores no more than `factor` of the mean so far."""
    return F.try_divide(F.lit(factor) * total, decisions) >= score


def pagination_by_likeness(similar: DataFrame, least: float = 0.8, share: float = 0.5) -> DataFrame:
    """Actions most of whose samples (page_url, xpath, sim) are more than `least` like their page."""
    return similar.groupBy("page_url", "xpath").agg(F.avg((F.col("sim") > least).cast("double")).alias("share")).filter(F.col("share") > share)


def updated(first: DataFrame, second: DataFrame, by: tuple[str, ...] = ("page",)) -> DataFrame:
    """Links (by, xpath, href) that the first has and the second has not, summed over the first's actions."""
    left = first.select(*by, "xpath", "href").distinct()
    gone = left.join(second.select(*by, "xpath", "href").distinct(), [*by, "xpath", "href"], "left_anti")
    n = gone.groupBy(*by).agg(F.count("*").alias("updated"))
    return left.select(*by).distinct().join(n, list(by), "left").select(*by, F.coalesce("updated", F.lit(0)).alias("updated"))


def paginator_by_update(samples: DataFrame) -> DataFrame:
    """The action whose samples (page_url, xpath, updated) differ most from the page on average."""
    mean = samples.groupBy("page_url", "xpath").agg(F.avg("updated").alias("score"))
    return richest(mean)


def paginators_by_weakness(tokens: DataFrame) -> DataFrame:
    """Actions (page_url, xpath, tokens array) from the shortest mean token length up; 0 without tokens."""
    flat = tokens.select("page_url", "xpath", F.explode_outer("tokens").alias("t"))
    mean = flat.groupBy("page_url", "xpath").agg(F.coalesce(F.avg(F.length("t")), F.lit(0.0)).alias("weight"))
    return mean.withColumn("place", F.row_number().over(Window.partitionBy("page_url").orderBy("weight", "xpath")))


def weak_paginators(links: DataFrame, similar: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """Candidates for pagination: scored below the page's mean, sharing a token with the vocabulary (if given), and
    like the page in most samples; with their links and vocabulary, weakest first."""
    weak = below_average(token_scores(links))
    own = links.join(weak.select("page_url", "xpath"), ["page_url", "xpath"], "left_semi")
    words = own.groupBy("page_url", "xpath").agg(
        F.array_sort(F.collect_set("href")).alias("hrefs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_union("url_tokens", "text_tokens"))))).alias("tokens")
    )
    if vocabulary is not None:
        words = words.filter(F.arrays_overlap("tokens", F.array(*(F.lit(v) for v in vocabulary))))
    words = words.join(pagination_by_likeness(similar).select("page_url", "xpath"), ["page_url", "xpath"], "left_semi")
    return words.join(paginators_by_weakness(words), ["page_url", "xpath"])

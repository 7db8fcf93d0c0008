"""Leaf pages: structural features and a stored linear model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.paths import action_of
from linkloom.sources.html import dom_nodes

# Element names that mark formatting, matched anywhere in a path.
FORMATTING = ("b", "em", "i", "small", "strong", "sub", "sup", "ins", "del", "mark", "p")
#: The stored model collapsed to one weight a feature, and its offset.
WEIGHTS = (0.006107788947750795, -0.5526445082337421, 0.0013357826516653404, 0.004063144992997536, -0.009988750687625725, 0.03476079339856142)
RHO = -2.545709699994723
FEATURES = tuple("ABCDEFGHIJ")


def leaf_features(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """page_url and features A to J. keep: columns to carry that tell pages of one address apart.

    A, B: mean over text paths (text paths inside anchors) of the mean trimmed length; C: distinct text paths less D;
    D: distinct anchor text paths; E: largest mean length; F: text paths with a formatting tag less G; G: anchor ones;
    H, I: p and br elements; J: punctuation but < > { } [ ] , over length, summed over texts. A page without
    (anchor) texts has null means.
    """
    nodes = dom_nodes(pages, html, url, keep).withColumn("xpath", action_of(F.col("path")))
    some, trimmed = F.length("text") > 0, F.length(F.trim("text"))
    marks = F.length("text") - F.length(F.regexp_replace("text", r"[!\"#$%&'()*+\-./:;=?@\\^_`|~]", ""))
    # One parse and one exchange: dealt by page, then grouped by page and path, then by page.
    per = nodes.repartition(*keep, "page_url").groupBy(*keep, "page_url", "xpath").agg(
        F.avg(F.when(some & (trimmed > 0), trimmed)).alias("m"),
        F.sum(F.when(some, marks / F.length("text"))).alias("punct"),
        F.count_if(F.col("tag") == "p").alias("p"),
        F.count_if(F.col("tag") == "br").alias("br"),
    )
    real = F.col("m").isNotNull()
    anchor, form = F.col("xpath").rlike("/a(?:/|\\[|$)"), F.col("xpath").rlike("|".join(FORMATTING))
    return per.groupBy(*keep, "page_url").agg(
        F.avg("m").alias("A"),
        F.avg(F.when(anchor, F.col("m"))).alias("B"),
        F.count_if(real & ~anchor).alias("C"),
        F.count_if(real & anchor).alias("D"),
        F.max("m").alias("E"),
        F.count_if(real & form & ~anchor).alias("F"),
        F.count_if(real & form & anchor).alias("G"),
        F.sum("p").alias("H"),
        F.sum("br").alias("I"),
        F.sum("punct").alias("J"),
    )


def decision_value(features: list[Column], weights: tuple[float, ...] = WEIGHTS, rho: float = RHO) -> Column:
    """w.x - rho; positive means not a leaf."""
    total = F.lit(-rho)
    for x, w in zip(features, weights):
        total = total + x * F.lit(w)
    return total


def is_leaf(features: list[Column], weights: tuple[float, ...] = WEIGHTS, rho: float = RHO) -> Column:
    return decision_value(features, weights, rho) < 0


def accuracy(predictions: DataFrame, predicted: str = "predicted", label: str = "label") -> DataFrame:
    """n, correct and accuracy."""
    ok = F.count_if(F.col(predicted) == F.col(label))
    return predictions.agg(F.count("*").alias("n"), ok.alias("correct"), F.try_divide(ok.cast("double"), F.count("*").cast("double")).alias("accuracy"))


def load_linear_model(spark: SparkSession, path: str) -> tuple[tuple[float, ...], float]:
    """Weights and rho of a linear model in libsvm's text format: the sum of coefficient times support vector. Only the
    weights, one a feature, reach the driver."""
    lines = spark.read.text(path)
    rho = lines.filter(F.col("value").startswith("rho ")).select(F.split("value", " ")[1].cast("double")).first()[0]
    vec = lines.filter(F.col("value").rlike(r"^[-+0-9.eE]+( +[0-9]+:)")).select(F.split(F.trim("value"), " +").alias("v"))
    term = vec.select(F.col("v")[0].cast("double").alias("c"), F.explode(F.slice("v", F.lit(2), F.size("v"))).alias("t"))
    w = term.select(F.split("t", ":")[0].cast("int").alias("i"), (F.col("c") * F.split("t", ":")[1].cast("double")).alias("x")).groupBy("i").agg(F.sum("x").alias("w")).orderBy("i").collect()
    found = {r.i: r.w for r in w}
    return tuple(found.get(i, 0.0) for i in range(1, max(found, default=0) + 1)), rho

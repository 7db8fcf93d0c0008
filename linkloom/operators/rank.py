"""Scores that rank actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIOR = 10


def enum_score(n_hrefs: Column, df: Column, novelty: Column, update: Column) -> Column:
    return F.ln(n_hrefs + PRIOR) / df * novelty * update


def enum_score_no_df(n_hrefs: Column, novelty: Column) -> Column:
    return F.ln(n_hrefs + PRIOR) * novelty


def rank_enum_candidates(candidates: DataFrame, use_df: bool = True) -> DataFrame:
    """candidates: xpath, n_hrefs, df, avg_novelty, avg_update; adds score, best first, ties to the smaller xpath."""
    c = F.col
    score = enum_score(c("n_hrefs"), c("df"), c("avg_novelty"), c("avg_update")) if use_df else enum_score_no_df(c("n_hrefs"), c("avg_novelty"))
    return candidates.withColumn("score", score).orderBy(F.desc("score"), "xpath")


def rank_content_xpaths(values: DataFrame, xpath: str = "xpath", value: str = "value") -> DataFrame:
    """Mean times population variance times count of each action's values, best first."""
    agg = values.groupBy(F.col(xpath).alias("xpath")).agg((F.avg(value) * F.var_pop(value) * F.count(value)).alias("score"))
    return agg.orderBy(F.desc("score"), "xpath")


def rank_by_uniqueness(links: DataFrame, by: tuple[str, ...] = ("xpath",)) -> DataFrame:
    """links: text_len and path_len. mean = (sum of both) / links, var = (squared distances of both from it) / links;
    score = mean * var, by the sums of lengths and of their squares, in one pass."""
    agg = links.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(F.col("text_len") + F.col("path_len")).cast("double").alias("s"),
        F.sum(F.col("text_len") * F.col("text_len") + F.col("path_len") * F.col("path_len")).cast("double").alias("q"),
    )
    mean = F.col("s") / F.col("n")
    var = (F.col("q") - 2 * mean * F.col("s") + 2 * F.col("n") * mean * mean) / F.col("n")
    return agg.select(*by, (mean * var).alias("score")).orderBy(F.desc("score"), *by)

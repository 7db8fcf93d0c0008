"""Pipeline over documents: quality, near duplicates, benchmark decontamination, personal data, source mix.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; run() writes
each stage's result to the shared folder and reads it again for the next. All but the last return the columns of
documents. Nulls in any column, empty texts, repeated rows and empty tables go through every stage as its operator's
docstring says; further columns go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import decontam, jaccard, mixing, pii, quality
from linkloom.llm._common import fresh, materialize, read

THRESHOLD = 0.7


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below THRESHOLD go. Learns from the labelled rows among docs that are not held out."""
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    own = fresh(docs, "_quality")
    return quality.score(docs, model, out=own).filter(F.col(own) >= THRESHOLD).drop(own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold eight consecutive words of a benchmark item go, and so do those that hold two items.

    A hit on one item of fewer than eight words alone says too little, and such documents stay.
    """
    return decontam.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets; n_chars follows the text."""
    fields = docs.columns
    own = fresh(docs, "_pii")
    new = pii.redact(pii.find_pii(docs, out=own), spans=own)
    if "n_chars" in fields:
        n = F.when(F.size(own) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        new = new.withColumn("n_chars", n)
    return new.select(*fields)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies and taken words."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
]

#: The fitted classifier and the hashes of the mix have no form in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""The pipeline: stages on edge cases, and a run against plain versions of its stages."""

import os
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

sys.path.insert(0, os.path.dirname(__file__))

import brute as B  # noqa: E402

from linkloom.llm import decontam, mixing, pii, quality  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_run(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if model.score(quality.features((r.text or "").encode())) >= P.THRESHOLD]
    keep = {c for k, _, c in B.classes([r[:2] for r in rows], 5, 80, 100)}
    rows = [r for r in rows if r[0] in keep]
    items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    find = decontam.Automaton(items, 8)
    scan = {r[0]: find.scan(decontam.fold((r[1] or "").encode()).split()) for r in rows}
    rows = [r for r in rows if (scan[r[0]][0] is None or scan[r[0]][0].sum() < 8) and len(scan[r[0]][1]) < 2]
    left = spark.createDataFrame([(k, t, s) for k, t, s in rows], "doc_id long, text string, source string")
    clean = pii.redact(pii.find_pii(left))
    want = {(r.doc_id, r.copies) for r in mixing.mix_sources(clean.select("doc_id", "text", "source")).filter("copies > 0").collect()}
    out = P.run(spark, SF)
    assert {(r.doc_id, r.copies) for r in out.collect()} == want and len(want) > 50
    assert out.filter(F.col("text").contains("@mail")).isEmpty()


#: Names that operators use, or once used, on the way.
CLASHES = ("pii", "_pii", "_s", "_ss", "_d", "_kept", "_pii_email", "_found__pii_email", "_quality", "row_hash", "_rows", "size", "doc", "set")


def test_stages_on_edges(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "no such words here at all, none of them")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.createDataFrame(B.EDGE, B.SCHEMA).withColumns({"n_chars": F.length("text").cast("long"), **{c: F.lit(1) for c in CLASHES}})
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        more = ["copies", "taken"] if name == P.STAGES[-1][0] else []
        assert out.columns == docs.columns + more, name
        assert out.count() <= docs.count() and stage(spark, docs.limit(0), sf).count() == 0, name

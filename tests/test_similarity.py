"""Similarity, clusters, ranks and classification."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.operators import classify, cluster, rank
from linkloom.operators import similarity as S
from linkloom.operators.components import connected_components


def test_near_duplicates(spark):
    w = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w)), (3, " ".join(w[:-1])), (4, " ".join(w[:20])), (5, "a b"), (6, None)], "doc_id long, text string")
    got = {(r.a, r.b, r.inter) for r in S.near_duplicate_pairs(docs).collect()}
    assert got == {(1, 2, 37), (1, 3, 36), (2, 3, 36)}
    assert S.near_duplicate_pairs(docs.limit(0)).count() == 0
    known = spark.createDataFrame([(9, " ".join(w))], "item_id long, text string")
    assert {r.doc_id for r in S.seen(docs, known).collect()} == {1, 2, 3}


def test_signatures(spark):
    sig = spark.createDataFrame([("p", "x", 3), ("p", "y", 1), ("q", "x", 1), ("q", "z", 2)], "page string, xpath string, n long")
    r = S.signature_similarities(sig).first()
    assert math.isclose(r.cosine, 3 / math.sqrt(50)) and r.cardinality == pytest.approx(0.5) and r.similarity == pytest.approx(1.5 / math.sqrt(50))
    d = S.signature_distance(sig.filter("page = 'p'").drop("page"), sig.filter("page = 'q'").drop("page")).first()
    assert d.distance == 5 and d.manhattan == 5 and d.similarity == pytest.approx(2 / 7)


def test_tree_similarity():
    page = "<html><body><p>a</p></body></html>"
    assert S.tree_similarity_of(page, page) == 1.0
    assert S.tree_similarity_of(None, page) == 0.0
    one = lambda leaf: S._Tree(S.parse(f"<html><body>{leaf}</body></html>").children[0], {})
    shapes = {}
    x, y, z = (S._Tree(S.parse(f"<body>{t}</body>").children[0], shapes) for t in ("<p>a</p>", "<p class='k'>a</p>", "<b>a</b>"))
    sim = lambda a, b: 1 - S.tree_edit_distance(a, b) / (a.size + b.size)
    assert sim(x, x) == 1.0 and sim(x, y) == 1.0 and sim(x, z) == 0.5 and one("<p>")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "<b>", "</p>", "<div>", "</div>", "x"]), max_size=12))
def test_tree_with_itself(parts):
    page = "<p>" + "".join(parts)
    assert S.tree_similarity_of(page, page) == 1.0


def test_clusters(spark):
    points = spark.createDataFrame([(c,) for c in "abcdef"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "a string, b string")
    assert {(r.id, r.cluster) for r in cluster.cluster(points, edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f")}
    assert cluster.cluster(points.limit(0), edges.limit(0)).count() == 0
    one = {r.id: r.cluster for r in cluster.cluster_n_iters(points, edges, 1).collect()}
    assert one["c"] == "b" and one["b"] == "a"
    online = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "id string, seq long")
    got = {r.id: r.cluster for r in cluster.assign_online(spark.createDataFrame([], "id string, cluster long"), online, spark.createDataFrame([("a", "c"), ("b", "c")], "a string, b string")).collect()}
    assert got["c"] == got["b"] != got["a"] and len(set(got.values())) == 3
    some = spark.createDataFrame([("a", 0), ("d", 1)], "id string, cluster long")
    assert {r["id"]: r["index"] for r in cluster.assign(some, points.filter("id in ('b', 'f')"), edges).collect()} == {"b": 0, "f": -1}
    assert [r["size"] for r in cluster.cluster_urls(cluster.cluster(points, edges)).collect()] == [3, 2, 1]


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_scores(spark):
    links = spark.createDataFrame([("x", ["a"], ["b"]), ("x", ["a", "b", "c"], ["d"])], "xpath string, url_tokens array<string>, text_tokens array<string>")
    from linkloom.operators.decisions import token_scores

    assert token_scores(links, ("xpath",)).first().score == pytest.approx(3.0)
    u = spark.createDataFrame([("x", 4, 2), ("x", 6, 0)], "xpath string, text_len long, path_len long")
    mean = 12 / 2
    var = ((4 - mean) ** 2 + (2 - mean) ** 2 + 0 + mean**2) / 2
    assert rank.rank_by_uniqueness(u).first().score == pytest.approx(mean * var)


def test_linear_model(spark, tmp_path):
    f = tmp_path / "m.model"
    f.write_text("svm_type c_svc\nkernel_type linear\nrho -1.5\nlabel -1 1\nSV\n0.5 1:2 3:1 \n-0.25 1:4 2:8 \n")
    w, rho = classify.load_linear_model(spark, str(f))
    assert w == (0.0, -2.0, 0.5) and rho == -1.5
    row = spark.createDataFrame([(1.0, 1.0, 0.0)], "a double, b double, c double").select(classify.decision_value([F.col(c) for c in "abc"], w, rho).alias("v")).first()
    assert row.v == -0.5


def test_leaf_features(spark):
    p = spark.createDataFrame([("http://h/", "<body><p>abc</p><p>a</p><a href='/x'>link!</a><br></body>")], "url string, html string")
    r = classify.leaf_features(p).first()
    assert (r.A, r.B, r.C, r.D, r.E, r.H, r.I) == (3.5, 5.0, 1, 1, 5.0, 2, 1) and r.J == pytest.approx(0.2)

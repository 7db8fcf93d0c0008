"""Models, traversal, idioms, readers and writers, streams and the driver's entry."""

import gzip

from pyspark.sql import functions as F

import __spark_entry__ as entry
from linkloom.operators import relational as R
from linkloom.plans import model as M
from linkloom.plans import traverse as T
from linkloom.sources import tables as IO
from linkloom.streaming import pages as SP

DOC = "url string, src_url string, path array<string>, leaf boolean"


def test_yield_loop_is_as_long_as_the_sequences(spark):
    acts = list("abcdef")
    s = spark.createDataFrame([(7, acts)], "seq_id long, actions array<string>")
    docs = spark.createDataFrame([(f"7/{k}", f"7/{k - 1}" if k else None, acts[6 - k :], k == 6, 7) for k in range(7)], DOC + ", _s long")
    n = spark.createDataFrame([(f"7/{k}", acts[5 - k], k + 2) for k in range(6)], "url string, action string, n long")
    paging = spark.createDataFrame([("none",)], "x string").selectExpr("array(x) AS src_path")
    assert entry.core._yield_by_sequence(s, docs, n, paging).first()["yield"] == 2 * 3 * 4 * 5 * 6 * 7


def site(spark):
    """root -> 4 boards, one of them with a second page; boards -> 3 threads each."""
    a = lambda items: "".join(f'<li><a href="{h}">{t}</a></li>' for h, t in items)
    rows = [("http://h/", f'<ul class="boards">{a([(f"/b{i}", f"Board {i}") for i in range(4)])}</ul>')]
    for i in range(4):
        more = '<div class="pages"><a href="/b0p2">2</a></div>' if i == 0 else ""
        rows.append((f"http://h/b{i}", f'<ul class="threads">{a([(f"/b{i}/t{j}", f"T{i}{j}") for j in range(3)])}</ul>{more}'))
    rows.append(("http://h/b0p2", f'<ul class="threads">{a([(f"/b0/u{j}", f"U{j}") for j in range(3)])}</ul>'))
    rows += [(f"http://h/b{i}/t{j}", f"<p>words of thread {i} {j}</p>") for i in range(4) for j in range(3)]
    rows += [(f"http://h/b0/u{j}", f"<p>late words {j}</p>") for j in range(3)]
    return spark.createDataFrame(rows, "url string, html string")


BOARDS, THREADS = "//html/body/ul[contains(@class, 'boards')]/li/a", "//html/body/ul[contains(@class, 'threads')]/li/a"
PAGES = "//html/body/div[contains(@class, 'pages')]/a"


def test_yield_and_plan(spark):
    docs = spark.createDataFrame([("r", None, [], False), ("x", "r", ["a"], False), ("l", "x", ["b", "a"], True)], DOC)
    n = spark.createDataFrame([("r", "a", 4), ("x", "b", 6)], "url string, action string, n long")
    seqs = spark.createDataFrame([(1, ["b", "a"])], "seq_id long, actions array<string>")
    assert M.estimate_yield(seqs, docs, n).first()["yield"] == 24
    paging = spark.createDataFrame([(["a"],)], "src_path array<string>")
    assert M.estimate_yield(seqs, docs, n, paging).first()["yield"] == 240
    plan = spark.createDataFrame([(["x", "y"], 10), (["z"], 3), (["p", "q"], 50)], "actions array<string>, n long")
    assert [r.n for r in M.plan_model(plan).collect()] == [3, 50, 10]


def test_crawl(spark):
    links = T.link_table(site(spark))
    leaves = site(spark).filter("html like '<p>%'").select("url")
    run = T.crawl(links, T.seed(spark, "http://h/"), leaves)
    assert run.counters["visited"] == 1 + 4 + 1 + 12 + 3 and run.counters["leaves"] == 15
    assert {tuple(r.path): r.n for r in run.model.collect()} == {(THREADS, BOARDS): 12, (THREADS, PAGES, BOARDS): 3}
    assert T.crawl(links, T.seed(spark, "http://h/"), leaves, T.Stop(visited=7)).visited.count() == 7
    assert T.crawl(links, T.seed(spark, "http://h/"), leaves, T.Stop(visited=7), order="random").visited.count() == 7
    few = T.crawl(links, T.seed(spark, "http://h/"), leaves, per_decision=1)
    assert few.counters["visited"] <= 6


def test_examples_and_model(spark):
    pages = site(spark)
    leaves = pages.filter("html like '<p>%'").select("url")
    run = T.crawl_examples(pages, T.seed(spark, "http://h/"), leaves)
    # One example a cluster: the boards are alike, and so are the threads of one.
    assert 3 <= run.counters["visited"] < 10
    full = T.crawl(T.link_table(pages), T.seed(spark, "http://h/"), leaves)
    corpus = full.visited.join(pages.withColumnRenamed("html", "body"), "url")
    paging = M.detect_pagination(corpus, least=0.5).collect()
    assert [(r.src_path, r.paging_action) for r in paging] == [([BOARDS], PAGES)]
    seqs = spark.createDataFrame([(1, [THREADS, BOARDS])], "seq_id long, actions array<string>")
    ref = {r.action for r in M.refine_action_seq(corpus, seqs).collect()}
    assert ref == {THREADS, BOARDS}


def test_estimation(spark):
    leaves = site(spark).filter("html like '<p>%'").select("url")
    run, clusters, (seqs, refs, paging) = T.crawl_with_estimation(site(spark), T.seed(spark, "http://h/"), leaves)
    assert run.counters["leaves"] >= 1 and clusters.select("cluster").distinct().count() == 1
    assert (THREADS, BOARDS) in {tuple(r.actions) for r in seqs.collect()} and refs.count() >= 2 and paging.count() <= 1


def test_replay(spark):
    links = T.link_table(site(spark))
    start = T.seed(spark, "http://h/")
    assert T.replay(links, start, [THREADS, BOARDS]).counters["leaves"] == 12
    paging = spark.createDataFrame([([BOARDS], PAGES)], "src_path array<string>, paging_action string")
    run = T.replay(links, start, [THREADS, BOARDS], paging=paging)
    assert run.counters["leaves"] == 15
    assert T.replay(links, start, [THREADS, BOARDS], budget=8).visited.count() == 8
    done = T.execute_plan(links, start, [[BOARDS], [THREADS, BOARDS]], budget=12)
    assert {r.seq_no for r in done.collect()} == {0, 1}
    seen = T.consecutive_duplicates(T.replay(links, start, [BOARDS]).visited.filter("leaf"), site(spark))
    assert seen.count() == 4


def test_pagination_pruning(spark):
    c = spark.createDataFrame([(["a"], "p"), (["p", "a"], "q"), (["a"], "z")], "src_path array<string>, action string")
    assert [(r.src_path, r.actions) for r in M.pagination_in_corpus(c).collect()] == [(["a"], ["p", "z"])]
    pair = "array<struct<p:int,ns:array<int>>>"
    seqs = spark.createDataFrame([(1, ["b", "p", "a"]), (2, ["b", "a"])], "seq_id long, actions array<string>")
    refs = spark.createDataFrame([(1, ["p", "a"], "b", [(1, [0])], []), (2, ["a"], "b", [(1, [0])], [])], f"seq_id long, src_path array<string>, action string, only {pair}, avoid {pair}")
    paging = spark.createDataFrame([(["a"], "p", [(1, [0])], [])], f"src_path array<string>, paging_action string, only {pair}, avoid {pair}")
    assert [r.seq_id for r in M.remove_pagination(seqs, refs, paging).collect()] == [2]


def test_idioms(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert {(r.k, r.v) for r in R.merge_maps([a, b], ["k"]).collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert {(r.k, r.v) for r in R.merge_with(a, b, ["k"], "v", lambda x, y: F.concat(x, y)).collect()} == {(1, "x"), (2, "yz"), (3, "w")}
    assert R.sample_proportional(spark.createDataFrame([(1, 1.0), (2, 3.0)], "k int, s double"), "s", 0.3, "k").first().k == 2
    item, rest = R.dequeue(a, "k", True)
    assert item.first().k == 1 and rest.count() == 1
    rows = spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5])], "k int, v array<int>")
    assert [(r.pos, r["values"]) for r in R.transpose(rows, "k", "v").orderBy("pos").collect()] == [(0, [1, 4]), (1, [2, 5])]
    links = spark.createDataFrame([(f"u{i}",) for i in range(100)], "url string")
    assert R.sample_links(links, links.limit(20)).count() == 8 and R.sample_decision(links, links.limit(20)).count() == 20


def test_files(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "list.txt").write_text("http://h/a\nhttp://h/b x\n")
    assert [r.value for r in IO.read_pieces(spark, f"{p}/list.txt").collect()] == ["http://h/a", "http://h/b", "x"]
    pages = spark.createDataFrame([("http://h/a", "<p>\n</p>", ["http://h/old"])], IO.SCHEMAS["pages"])
    failed = IO.download_links(spark, f"{p}/list.txt", pages, f"{p}/out", gzip=True)
    assert [r.url for r in failed.collect()] == ["http://h/b x"]
    (f,) = (tmp_path / "out").glob("*.gz")
    assert gzip.open(f, "rt").read() == "<p> </p>\n"
    found, _ = IO.fetch(spark.createDataFrame([("http://h/old",)], "url string"), pages)
    assert found.first().url == "http://h/a"
    feats = spark.createDataFrame([(1.0, 2.0, True), (None, 1.0, False)], "A double, B double, leaf boolean")
    IO.write_arff(feats, f"{p}/arff", names=("A", "B"))
    assert [r.value for r in spark.read.text(f"{p}/arff/1-data").collect()] == ["1.0,2.0,1"]
    assert IO.exists(spark, f"{p}/arff") and not IO.exists(spark, f"{p}/none")
    path = IO.dump_run(f"{p}/run", {"visited": spark.createDataFrame([("u",)], "url string")})
    assert IO.read_table(spark, f"{path}/visited", "visited").first().url == "u"


def test_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    site(spark).withColumn("redirects", F.array().cast("array<string>")).write.parquet(src)
    SP.stream_decisions(SP.read_pages(spark, src), out, ck).awaitTermination(120)
    assert spark.read.parquet(out).filter("page_url = 'http://h/'").count() == 1


def test_entry(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60
    rows = entry.entry(spark)
    assert rows.count() == 50 and rows.agg(F.sum("score")).first()[0] == 279

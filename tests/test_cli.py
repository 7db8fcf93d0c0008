"""The command line: learning, fixing and replaying a model over a page store; many sites; the log."""

import pytest
from pyspark.sql import functions as F
from test_plans import BOARDS, PAGES, THREADS, site

from linkloom import cli
from linkloom.operators.links import REFINEMENT
from linkloom.plans import model as M
from linkloom.sources.tables import read_table


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    site(spark).write.mode("overwrite").parquet(path)
    return path


def test_learn_and_replay(spark, store, tmp_path):
    common = ["--pages", store, "--start", "http://h/", "--log", str(tmp_path / "log")]
    learnt = cli.main(["discussion-forum", *common, "--example", "http://h/b0/t0", "--num-leaves", "50", "--out", str(tmp_path / "a")])
    sequences = read_table(spark, f"{learnt}/model", "model_actions")
    assert [THREADS, BOARDS] in [r.actions for r in sequences.collect()]
    assert read_table(spark, f"{learnt}/clusters", "leaf_clusters").count() > 0
    one = spark.read.parquet(cli.main(["execute", *common, "--model", learnt, "--out", str(tmp_path / "e")]) + "/corpus")
    assert one.count() >= 1
    learnt = cli.main(["structure-driven", *common, "--example", "http://h/b0/t0", "--num-leaves", "50", "--out", str(tmp_path / "f")])
    done = spark.read.parquet(cli.main(["execute", *common, "--model", learnt, "--out", str(tmp_path / "b")]) + "/corpus")
    urls = {r.url for r in done.collect()}
    assert len(urls) >= 12 and all("/t" in u or "/u" in u for u in urls) and done.filter("body is null").isEmpty()
    few = spark.read.parquet(cli.main(["execute-budget", *common, "--model", learnt, "--budget", "7", "--out", str(tmp_path / "c")]) + "/corpus")
    assert {r.url for r in few.collect()} < urls
    some = f"{tmp_path}/stored"
    done.filter("url like '%t0'").select("url").write.parquet(some)
    rest = spark.read.parquet(cli.main(["execute", *common, "--model", learnt, "--stored", some, "--out", str(tmp_path / "d")]) + "/corpus")
    assert {r.url for r in rest.collect()} == {u for u in urls if not u.endswith("t0")}
    assert "executed" in (tmp_path / "log").read_text()
    with pytest.raises(SystemExit):
        cli.main(["execute", *common, "--model", str(tmp_path / "none")])


def test_refinements_are_followed(spark, store, tmp_path):
    """A model whose only-list lets the first board through alone."""
    pages = spark.read.parquet(store)
    crawl = cli.learn(pages, cli.X.seed(spark, "http://h/"), pages.filter("html like '<p>%'").select("url"), "structure-driven", 100, str(tmp_path / "a"))
    ref = spark.createDataFrame([(1, [], BOARDS, [(3, [0])], [])], f"seq_id long, src_path array<string>, action string, only {REFINEMENT}, avoid {REFINEMENT}")
    ref.write.mode("overwrite").parquet(f"{crawl}/refinements")
    spark.createDataFrame([(1, [THREADS, BOARDS])], "seq_id long, actions array<string>").write.mode("overwrite").parquet(f"{crawl}/model")
    done = spark.read.parquet(cli.execute(pages, cli.X.seed(spark, "http://h/"), crawl, str(tmp_path / "b")) + "/corpus")
    assert {r.url for r in done.collect()} - {f"http://h/b0/u{j}" for j in range(3)} == {f"http://h/b0/t{j}" for j in range(3)}


def test_probes(spark, store):
    pages = spark.read.parquet(store)
    crawl = cli.X.crawl(cli.X.link_table(pages), cli.X.seed(spark, "http://h/"), pages.filter("html like '<p>%'").select("url"), per_decision=None)
    corpus = cli._bodies(crawl.visited, pages)
    seqs = spark.createDataFrame([(1, [THREADS, BOARDS]), (2, [PAGES, BOARDS])], "seq_id long, actions array<string>")
    # Boards 1 and 9: the first shows threads (so it may not be avoided), the other is not there; no board but 0 has pages.
    ref = spark.createDataFrame([(s, [], BOARDS, [], [(3, [1]), (3, [9])]) for s in (1, 2)], f"seq_id long, src_path array<string>, action string, only {REFINEMENT}, avoid {REFINEMENT}")
    got = {r.seq_id: [(x.p, x.ns) for x in r.avoid] for r in M.probe_restrictions(corpus, seqs, ref).collect()}
    assert got == {1: [(3, [9])], 2: [(3, [1]), (3, [9])]}


def test_many_sites_and_log(spark, store, tmp_path):
    (tmp_path / "list").write_text("http://h/\nhttp://gone/\n\n")
    pages = spark.read.parquet(store)
    gone = cli.crawl_sites(spark, str(tmp_path / "list"), pages, pages.filter("html like '<p>%'").select("url"), 100, str(tmp_path / "out"))
    assert [r.url for r in gone.collect()] == ["http://gone/"]
    corpus = spark.read.parquet(str(tmp_path / "out") + "/*/corpus")
    assert corpus.count() == 21 and corpus.filter(F.col("site") != "http://h").isEmpty()
    cli.log_to(str(tmp_path / "log"))
    assert cli.say("a", 1) == "a 1" and "a 1" in (tmp_path / "log").read_text()

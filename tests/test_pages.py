"""Parsing, paths, links and decisions, on pages written by hand."""

from pyspark.sql import functions as F

from linkloom.functions import paths as P
from linkloom.functions import text as X
from linkloom.operators import decisions as D
from linkloom.operators import links as L
from linkloom.sources import html as H

ANCHORS = "<html><body><a href='a.html'>A</a><a href='b.html'>B</a><a href='c.html'>C</a><a href='d.html'>D</a></body></html>"
LISTS = (
    '<body><ul class="nav1"><li><a href="/x">X</a><li><a href="/y">Y</a></ul>'
    '<ul class="threads-list"><li><a href="/t/1">One</a></li><li><a href="/t/2">Two</a></li><li><a href="/x">X</a></li>{}</ul></body>'
)
ROW = '<tr><td><a href="/p{0}">{0}</a></td><td><a href="/q{0}">q</a></td></tr>'
TABLE = "<table>" + "".join(ROW.format(i) for i in range(5)) + "</table>"


def pages(spark, *bodies, url="http://h/d/p.html"):
    return spark.createDataFrame([(url if len(bodies) == 1 else f"{url}?{i}", b) for i, b in enumerate(bodies)], "url string, html string")


def test_anchor_page(spark):
    d, nav = D.state_action(pages(spark, ANCHORS))
    (row,) = d.collect()
    assert (row.xpath, row.score) == ("//html/body/a", 4)
    assert [x.href for x in row.hrefs_and_texts] == [f"http://h/d/{c}.html" for c in "abcd"]
    assert nav.first().total_nav_info == 4
    own = L.links_with_position(L.page_links(pages(spark, ANCHORS)))
    assert {r.xpath_pos for r in own.collect()} == {"//html/body/a"}


def test_two_lists(spark):
    d, nav = D.state_action(pages(spark, LISTS.format("")))
    got = [(r.xpath, r.score) for r in d.orderBy("rank").collect()]
    assert got == [("//html/body/ul[contains(@class, 'threads')]/li/a", 3), ("//html/body/ul[contains(@class, 'nav')]/li/a", 2)]
    assert nav.first().total_nav_info == 9
    d, nav = D.state_action(pages(spark, LISTS.format('<li><a href="/y">Y</a></li>')))
    assert [(r.score) for r in d.collect()] == [4] and nav.first().total_nav_info == 10


def test_link_filters(spark):
    body = (
        '<a href="/n" rel="nofollow">n</a><a href="/m" rel="nofollow noopener">m</a><a href="javascript:void(0)">j</a><a href="http://other/q">o</a>'
        '<a href="/a#frag">f</a><a href="/a?x=1&amp;y=2">e</a><a>none</a>'
    )
    p = pages(spark, body, url="http://h/p")
    assert [r.href for r in L.page_links(p).orderBy("ord").collect()] == ["http://h/m", "http://h/a", "http://h/a?x=1&y=2"]
    gone = spark.createDataFrame([("http://h/a#frag",), ("http://h/m",)], "url string")
    assert [r.href for r in L.page_links(p, gone).collect()] == ["http://h/a?x=1&y=2"]


def test_table_positions_and_refinement(spark):
    own = L.page_links(pages(spark, TABLE, url="http://h/t"))
    pos = L.links_with_position(own).groupBy("xpath_pos").count().orderBy("xpath_pos").collect()
    assert [(r.xpath_pos, r["count"]) for r in pos] == [(f"//html/body/table/tbody/tr/td[{i}]/a", 5) for i in (1, 2)]
    labels = own.select("page_url", "href", F.col("href").contains("/p").alias("muscle"))
    ref = L.refine_accuracy(own, labels).first()
    # Rows differ as well, so only the cell has one step for all of a side.
    assert [(x.p, x.ns) for x in ref.only] == [(5, [0])] and [(x.p, x.ns) for x in ref.avoid] == [(5, [1])]
    refs = spark.createDataFrame([(ref.xpath, [(5, [0])], [(5, [1])])], f"xpath string, only {L.REFINEMENT}, avoid {L.REFINEMENT}")
    assert {r.href for r in L.eval_refined(own, refs).collect()} == {f"http://h/p{i}" for i in range(5)}
    assert {r.href for r in L.refinement_candidates(own, refs).collect()} == {f"http://h/q{i}" for i in range(5)}
    alt = L.position_alternatives(own, ref.xpath, 2).select("depth").distinct().collect()
    assert [r.depth for r in alt] == [5]
    fetched = spark.createDataFrame([("http://h/q0", True)], "url string, good boolean")
    assert L.probe_refinements(own, refs, fetched, lambda f: F.coalesce(f["good"], F.lit(False))).count() == 0


def test_format_attr(spark):
    cases = [("post2", "post"), ("page-nav", "page"), ("a_b", "a"), ("class-tag2", "class"), ("12", ""), ("---", None), (None, None), ("-a", "")]
    df = spark.createDataFrame(cases, "a string, e string").select(P.format_attr(F.col("a")).alias("g"), "e", P.first_class(F.col("a")).alias("h"), "a")
    for r in df.collect():
        assert r.g == r.e == r.h == H.format_attr_text(r.a)


def test_parser_repairs():
    root = H.parse("<title>t</title><p>a<p><b>b<div>c</div><script>var t='</p>';</script><li>x<li>y<!-- no -->")
    tags = [n.tag for n in H.in_order(root) if isinstance(n, H.Node)]
    assert tags[:4] == ["html", "head", "title", "body"] and "script" not in tags and tags.count("li") == 2
    assert H.parse("").tag == "html" and H.links_of(None, None) == [] and H.nodes_of("<p>")[0]["tag"] == "html"


def test_nodes_and_xml(spark):
    p = pages(spark, '<div class="a b"><p>x<p>y &lt; z</div>')
    n = H.dom_nodes(p)
    assert n.filter("tag = 'p'").count() == 2
    again = L.child_positions(n).join(n.select("node_id", F.col("pos").alias("e")), "node_id")
    assert again.filter("pos <> e").isEmpty()
    xml = H.with_xml(p)
    assert xml.select(F.expr("xpath(xml, 'html/body/div/p/text()')").alias("v")).first().v == ["x", "y < z"]
    assert L.contained_anchors(H.dom_nodes(pages(spark, ANCHORS))).filter("node_id = 0").count() == 4
    assert L.node_siblings(n, True).count() == L.node_siblings(n).count() + n.count() - 1
    assert L.node_children(n).count() == n.count() - 1


def test_null_and_empty_pages(spark):
    p = spark.createDataFrame([(None, None), ("http://h/", ""), ("http://h/x", None)], "url string, html string")
    d, nav = D.state_action(p)
    assert d.count() == 0 and nav.count() == 0
    assert D.state_action(p.limit(0))[0].count() == 0


def test_paths(spark):
    row = spark.createDataFrame([(["c", "b", "a"], [2, 1, 2], "abcd", "abx")], "p array<string>, v array<int>, s string, t string").select(
        P.model_steps(F.col("p")).alias("steps"),
        P.action_at(F.col("p"), F.array(F.lit("a"))).alias("next"),
        P.source_path(F.col("p")).alias("src"),
        P.positions_at(F.col("v"), F.lit(2)).alias("at"),
        P.prefix_match(F.col("s"), F.col("t")).alias("m"),
        P.suffix_products(F.col("v")).alias("sp"),
    ).first()
    assert row.steps == [[], ["a"], ["b", "a"], ["c", "b", "a"]] and row.next == "b" and row.src == ["b", "a"]
    assert row.at == [2, 0] and row.m == 2 and row.sp == [4, 2, 2]


def test_older_steps(spark):
    rows = [("a", ["x", "y"], 2, "a[contains(@class,'x')][2]"), ("a", ["x"], None, "a[contains(@class,'x')]"), ("a", [], 0, "a[0]"), ("a", None, None, "a"), ("a", [None, "y"], None, "a"), (None, ["x"], 1, None)]
    df = spark.createDataFrame(rows, "tag string, classes array<string>, pos int, want string")
    for r in df.select("want", P.step_xpath(F.col("tag"), F.col("classes"), F.col("pos")).alias("got")).collect():
        assert r.got == r.want
    one = spark.createDataFrame([([("html", None, 0), ("body", "hello", 1), ("a", None, None)],), ([],), (None,)], "path array<struct<tag:string,cls:string,pos:int>>")
    assert [r.x for r in one.select(P.node_xpath(F.col("path")).alias("x")).collect()] == ["//html[0]/body[contains(@class,'hello')][1]/a", "//", None]


def test_text(spark):
    cases = [("http://a/b/c", "/d", True), ("http://a/b/c", "http://a/d", True), ("http://a/b/c", "http://d/e", False)]
    for r in spark.createDataFrame(cases, "s string, t string, e boolean").select(X.in_domain(F.col("s"), F.col("t")).alias("g"), "e").collect():
        assert r.g == r.e
    row = spark.createDataFrame([("A b, c d!", "http://h/x/Last%20One?q", "a(b)*", "runs/x.model")], "t string, u string, p string, m string").select(
        X.shingles(F.col("t")).alias("s"), X.tokenize_url(F.col("u")).alias("k"), X.escape_pattern(F.col("p")).alias("p"), X.model_file(F.col("m"), "corpus").alias("m"),
        X.dated_name("run", ".model", F.lit("2014-03-08 07:05:00").cast("timestamp")).alias("d"),
    ).first()
    assert row.s == ["a b c d"] and row.k == ["last%20one"] and row.p == r"a\(b\)\*" and row.m == "runs/x.corpus" and row.d == "run-8-3-2014-7-5.model"


def test_templates(spark):
    own = [("http://h/", i + 1, f"//x{i}", [(f"http://h/s{i}", "s"), ("http://h/t", "t")]) for i in range(6)]
    d = spark.createDataFrame(own, "page_url string, rank int, xpath string, hrefs_and_texts array<struct<href:string,text:string>>")
    seen = [(f"http://h/s{i}", "//x0", [("http://h/t", "t"), ("http://h/s0", "s")]) for i in range(6)]
    f = spark.createDataFrame(seen, "page_url string, xpath string, hrefs_and_texts array<struct<href:string,text:string>>")
    got = {(r.xpath, r.href, r.n) for r in D.template_links(d, f).collect()}
    assert got == {("//x0", "http://h/t", 6), ("//x0", "http://h/s0", 6)}

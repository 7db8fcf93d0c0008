"""Queries of the engine over the test tables, and the same in SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import paths as P
from linkloom.functions import text as X
from linkloom.operators import classify, cluster, decisions, links, rank, relational, similarity
from linkloom.plans import model, traverse
from linkloom.sources.scratch import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def r6_many(c: Column | str) -> Column:
    """As r6 for numbers from 0 to 1e9, without a decimal for each: for results of very many rows."""
    return F.floor(F.col(c) * 1e6 + 0.5) / 1e6


# ------------------------------------------------------------------ pages

_A = r"""anchors AS (
    SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^(https?://[^/]+)', 1) AS site,
           unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS raw,
           unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
           unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')))) AS ord
    FROM pages
)"""
_ACTION = "//html/body/nav/ul/li/a"


@query(f"""WITH {_A} SELECT url AS page_url, '{_ACTION}' AS xpath, count(DISTINCT (raw, text)) AS score,
    sum(length(text))::BIGINT AS total_nav_info, 1 AS rank FROM anchors GROUP BY url""")
def state_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, nav = decisions.state_action(read(spark, sf_dir, "pages"))
    return d.join(nav, "page_url").select("page_url", "xpath", "score", "total_nav_info", "rank")


@query(f"""WITH {_A} SELECT url AS page_url, ord::INTEGER AS ord, '{_ACTION}' AS xpath, site || raw AS href, text, length(text) AS n_chars FROM anchors""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_links(read(spark, sf_dir, "pages")).select("page_url", "ord", "xpath", "href", "text", "n_chars")


@query(f"WITH {_A} SELECT url AS page_url, '{_ACTION}' AS xpath, count(*) AS n FROM anchors GROUP BY url")
def anchor_xpath_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.anchor_histogram(read(spark, sf_dir, "pages"))


@query(f"WITH {_A} SELECT DISTINCT url AS page_url, raw AS href FROM anchors")
def body_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.body_links(read(spark, sf_dir, "pages"))


@query(f"WITH {_A} SELECT url AS page_url, '{_ACTION}' AS xpath_pos, count(*) AS n FROM anchors GROUP BY url")
def links_with_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = links.links_with_position(links.page_links(read(spark, sf_dir, "pages")))
    return own.groupBy("page_url", "xpath_pos").agg(F.count("*").alias("n"))


def _half(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = links.page_links(read(spark, sf_dir, "pages"))
    ref = spark.createDataFrame([(_ACTION, [(4, [0, 1])], [(4, [1, 2])])], f"xpath string, only {links.REFINEMENT}, avoid {links.REFINEMENT}")
    return own, ref


@query(f"WITH {_A} SELECT url AS page_url, ord::INTEGER AS ord, site || raw AS href FROM anchors WHERE ord = 0")
def eval_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.eval_refined(*_half(spark, sf_dir)).select("page_url", "ord", "href")


@query(f"WITH {_A} SELECT url AS page_url, ord::INTEGER AS ord, site || raw AS href FROM anchors WHERE ord IN (1, 2)")
def refinement_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.refinement_candidates(*_half(spark, sf_dir)).select("page_url", "ord", "href")


@query(f"""WITH {_A}, h AS (SELECT url, raw, min(ord) AS o, count(*) AS c FROM anchors GROUP BY url, raw)
    SELECT a.url AS page_url, count(DISTINCT CASE WHEN o % 3 = 0 THEN ord END) AS muscle_steps,
        count(DISTINCT CASE WHEN o % 3 <> 0 THEN ord END) AS fat_steps, count(DISTINCT ord) AS steps
    FROM anchors a JOIN h USING (url, raw) GROUP BY a.url""")
def refine_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = links.page_links(read(spark, sf_dir, "pages"))
    first = own.groupBy("page_url", "href").agg(F.min("ord").alias("o"))
    deep = own.join(first, ["page_url", "href"]).select("page_url", "o", F.col("path")[4].alias("step"))
    m = F.col("o") % 3 == 0
    return deep.groupBy("page_url").agg(
        F.count_distinct(F.when(m, F.col("step"))).alias("muscle_steps"), F.count_distinct(F.when(~m, F.col("step"))).alias("fat_steps"), F.count_distinct("step").alias("steps")
    )


@query(f"""WITH {_A}, h AS (SELECT url, raw, min(ord) AS o FROM anchors GROUP BY url, raw), s AS (
        SELECT a.url, count(DISTINCT ord) AS n, count(DISTINCT CASE WHEN o = 0 THEN ord END) AS m,
            min(CASE WHEN o = 0 THEN ord END) AS mp, count(DISTINCT CASE WHEN o <> 0 THEN ord END) AS f
        FROM anchors a JOIN h USING (url, raw) GROUP BY a.url)
    SELECT url AS page_url, CASE WHEN n > 1 AND m <= 1 THEN 1 ELSE 0 END AS n_only, CASE WHEN n > 1 AND m <= 1 THEN mp::INTEGER END AS only_pos,
        CASE WHEN n > 1 AND f = 1 THEN 1 ELSE 0 END AS n_avoid FROM s""")
def refine_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = links.page_links(read(spark, sf_dir, "pages"))
    labels = own.groupBy("page_url", "href").agg((F.min("ord") == 0).alias("muscle"))
    ref = links.refine_accuracy(own, labels)
    return ref.select("page_url", F.size("only").alias("n_only"), F.get(F.get("only", F.lit(0))["ns"], F.lit(0)).alias("only_pos"), F.size("avoid").alias("n_avoid"))


@query(f"""WITH {_A}, c AS (SELECT regexp_extract(host, '([a-z]+)$', 1) AS grp, raw, count(DISTINCT url) AS n FROM anchors GROUP BY ALL)
    SELECT grp, raw AS href, n FROM c WHERE n >= 5""")
def template_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = links.all_anchors(read(spark, sf_dir, "pages"))
    grp = F.regexp_extract(X.host(F.col("page_url")), "([a-z]+)$", 1)
    n = own.groupBy(grp.alias("grp"), F.col("raw").alias("href")).agg(F.count_distinct("page_url").alias("n"))
    return n.filter("n >= 5")


@query(f"""WITH {_A} SELECT a.url AS page_url, count(*) AS n, count(*) FILTER (WHERE regexp_extract(b.url, '^https?://([^/:?#]+)', 1) = regexp_extract(a.url, '^https?://([^/:?#]+)', 1)) AS inside
    FROM pages a JOIN pages b ON b.page_id BETWEEN a.page_id - 2 AND a.page_id + 2 GROUP BY a.url""")
def in_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    around = F.sequence(F.col("page_id") - 2, F.col("page_id") + 2)
    site = p.select(F.col("url").alias("site"), F.explode(around).alias("page_id"))
    both = site.join(p.select("page_id", F.col("url").alias("target")), "page_id")
    return both.groupBy(F.col("site").alias("page_url")).agg(F.count("*").alias("n"), F.count_if(X.in_domain(F.col("site"), F.col("target"))).alias("inside"))


@query()
def leaf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = classify.leaf_features(read(spark, sf_dir, "pages"), keep=("page_id",))
    return f.select("page_url", *(r6(F.col(x).cast("double")).alias(x.lower()) for x in classify.FEATURES))


@query()
def tree_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("html").alias("html_b"))
    pairs = p.select("page_id", F.col("html").alias("html_a")).join(nxt, "page_id")
    return similarity.tree_similarity(pairs).select("page_id", r6("sim").alias("sim"))


@query()
def structural_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("b"))
    pairs = p.select("page_id", F.col("url").alias("a")).join(nxt, "page_id").select("a", "b")
    return similarity.structural_similarity(similarity.xpath_chars(p), pairs).select("a", "b", r6("sim").alias("sim"))


# ------------------------------------------------------------------ documents

_TOK = "list_filter(string_split_regex(lower(text), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"
_PLAIN = r"trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]+', ' ', 'g'), '[ \t\n\v\f\r]+', ' ', 'g'))"


@query(f"SELECT doc_id, len({_TOK})::BIGINT AS n_tokens, len(list_distinct({_TOK}))::BIGINT AS n_distinct, md5(array_to_string({_TOK}, ' ')) AS tokens_md5 FROM documents")
def tokenize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tokenize(F.col("text"))
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("tokens_md5")
    )


@query("""SELECT page_id, array_to_string(list_filter(string_split_regex(lower(regexp_extract(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '[^/]*$')), '\\s+'), lambda x: x <> ''), ' ') AS tokens FROM pages""")
def tokenize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(X.tokenize_url(F.col("url")), " ").alias("tokens"))


_SH = f"""t AS (SELECT doc_id, string_split({_PLAIN}, ' ') AS w FROM documents), g AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM t WHERE len(w) >= 4))"""


@query(f"WITH {_SH} SELECT d.doc_id, count(s)::BIGINT AS n_shingles FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.shingle_counts(read(spark, sf_dir, "documents"), "doc_id", "text")


_PAIRS = f"""{_SH}, n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), p AS MATERIALIZED (
    SELECT a, b, i AS inter, na.n AS size_a, nb.n AS size_b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
    ) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 10 * i >= 9 * (na.n + nb.n - i))"""


@query(f"WITH {_PAIRS} SELECT * FROM p")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_duplicate_pairs(read(spark, sf_dir, "documents"))


@query(f"""WITH RECURSIVE {_PAIRS}, e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (
    SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o)
    SELECT doc_id AS id, min(o) AS cluster FROM r GROUP BY doc_id""")
def near_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.near_duplicate_clusters(read(spark, sf_dir, "documents"))


@query(f"""WITH {_PAIRS}, e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT doc_id, doc_id FROM documents),
    l AS MATERIALIZED (SELECT a, min(b) AS c FROM e GROUP BY a)
    SELECT e.a AS id, min(l.c) AS cluster FROM e JOIN l ON l.a = e.b GROUP BY e.a""")
def near_dup_clusters_2_iters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return cluster.cluster_n_iters(docs, similarity.near_duplicate_pairs(docs).select("a", "b"), 2, "doc_id")


@query("""WITH t AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
    w AS (SELECT k, id, string_split(""" + _PLAIN + """, ' ') AS w FROM t), g AS MATERIALIZED (
    SELECT DISTINCT k, id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT k, id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4)),
    n AS (SELECT k, id, count(*) AS n FROM g GROUP BY k, id)
    SELECT DISTINCT x.id AS doc_id FROM (SELECT x.id, y.id AS b, count(*) AS i FROM g x JOIN g y ON x.s = y.s AND x.k = 'd' AND y.k = 'b' GROUP BY ALL) x
    JOIN n na ON na.k = 'd' AND na.id = x.id JOIN n nb ON nb.k = 'b' AND nb.id = x.b WHERE 10 * i >= 9 * (na.n + nb.n - i)""")
def seen_against_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.seen(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id")


@query("""WITH t AS (SELECT CASE WHEN source < 'src14' THEN 'd' ELSE 'b' END AS k, doc_id AS id, text FROM documents),
    w AS (SELECT k, id, string_split(""" + _PLAIN + """, ' ') AS w FROM t), g AS MATERIALIZED (
    SELECT DISTINCT k, id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT k, id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4)),
    n AS (SELECT k, id, count(*) AS n FROM g GROUP BY k, id)
    SELECT DISTINCT x.id AS doc_id FROM (SELECT x.id, y.id AS b, count(*) AS i FROM g x JOIN g y ON x.s = y.s AND x.k = 'd' AND y.k = 'b' GROUP BY ALL) x
    JOIN n na ON na.k = 'd' AND na.id = x.id JOIN n nb ON nb.k = 'b' AND nb.id = x.b WHERE 10 * i >= 9 * (na.n + nb.n - i)""")
def seen_in_other_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    first = F.coalesce(F.col("source") < "src14", F.lit(False))
    return similarity.seen(d.filter(first), d.filter(~first), corpus_key="doc_id").select("doc_id")


# ------------------------------------------------------------------ signatures and ranks: events stand in for links
# user_id is a page, event_type an action, props an address, value a number of characters.


def _sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("page"), F.col("event_type").alias("xpath")).agg(F.count("*").alias("n"))


_SIG = "s AS (SELECT user_id AS page, event_type AS xpath, count(*) AS n FROM events GROUP BY ALL)"
_COS = f"""{_SIG}, m AS (SELECT page, sqrt(sum(n * n)) AS norm, count(*) AS size FROM s GROUP BY page), d AS (
    SELECT x.page AS a, y.page AS b, sum(x.n * y.n) AS dot, count(*) AS shared FROM s x JOIN s y ON x.xpath = y.xpath AND x.page < y.page GROUP BY ALL), c AS (
    SELECT a, b, dot / (ma.norm * mb.norm) AS cosine, shared / (sqrt(ma.size) * sqrt(mb.size)) AS cardinality FROM d JOIN m ma ON ma.page = a JOIN m mb ON mb.page = b)"""


@query("""SELECT p AS page, x AS xpath, count(e.event_id)::BIGINT AS n FROM (SELECT DISTINCT user_id AS p FROM events), (SELECT unnest(['view', 'click', 'gone']) AS x)
    LEFT JOIN events e ON e.user_id = p AND e.event_type = x GROUP BY ALL""")
def page_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_type").alias("xpath"))
    return similarity.page_signature(e, spark.createDataFrame([("view",), ("click",), ("gone",)], "xpath string"))


@query(f"WITH {_COS} SELECT a, b, round(cosine, 6) AS cosine FROM c")
def signature_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.signature_similarities(_sig(spark, sf_dir)).select("a", "b", r6_many("cosine").alias("cosine"))


@query(f"WITH {_COS} SELECT a, b, round(cardinality, 6) AS cardinality FROM c")
def signature_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.signature_similarities(_sig(spark, sf_dir)).select("a", "b", r6_many("cardinality").alias("cardinality"))


@query(f"WITH {_COS} SELECT a, b, round(cosine * cardinality, 6) AS similarity FROM c")
def signature_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.signature_similarities(_sig(spark, sf_dir)).select("a", "b", r6_many("similarity").alias("similarity"))


_W = "w AS (SELECT event_type AS xpath, ln(count(DISTINCT event_id)) / count(DISTINCT user_id) AS weight FROM events GROUP BY event_type)"


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.weights_table(read(spark, sf_dir, "events"), "event_type", "event_id", "user_id")


@query(f"WITH {_W} SELECT xpath, round(weight, 6) AS weight FROM w")
def weights_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("xpath", r6("weight").alias("weight"))


@query(f"""WITH {_SIG}, {_W}, v AS (SELECT page, xpath, n * weight AS n FROM s JOIN w USING (xpath)), m AS (SELECT page, sqrt(sum(n * n)) AS norm FROM v GROUP BY page)
    SELECT x.page AS a, y.page AS b, round(sum(x.n * y.n) / (any_value(ma.norm) * any_value(mb.norm)), 6) AS cosine FROM v x JOIN v y ON x.xpath = y.xpath AND x.page < y.page
    JOIN m ma ON ma.page = x.page JOIN m mb ON mb.page = y.page GROUP BY ALL""")
def weighted_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.signature_similarities(_sig(spark, sf_dir), _weights(spark, sf_dir)).select("a", "b", r6_many("cosine").alias("cosine"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sig(spark, sf_dir)
    return similarity.signature_distance(s, s.withColumn("page", F.col("page") - 1), 1.0, 2.0, ("page",))


_DIST = f"""{_SIG}, x AS (SELECT coalesce(a.page, b.page - 1) AS page, coalesce(a.n, 0) AS h1, coalesce(b.n, 0) AS h2
    FROM s a FULL JOIN s b ON a.page = b.page - 1 AND a.xpath = b.xpath)"""


@query(f"WITH {_DIST} SELECT page, sum(2.0 * greatest(h1 - h2, 0) + greatest(h2 - h1, 0))::DOUBLE AS distance, sum(abs(h1 - h2))::BIGINT AS manhattan FROM x GROUP BY page")
def signature_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("page", "distance", "manhattan")


@query(f"WITH {_DIST} SELECT page, round(1 - sum(2.0 * greatest(h1 - h2, 0) + greatest(h2 - h1, 0))::DOUBLE / sum(2.0 * h1 + h2)::DOUBLE, 6) AS similarity FROM x GROUP BY page")
def signature_edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("page", r6("similarity").alias("similarity"))


@query("""WITH c AS (SELECT event_type AS xpath, count(DISTINCT event_id) AS n_hrefs, count(DISTINCT user_id) AS df, avg(value) AS nov, max(value) AS upd FROM events GROUP BY event_type)
    SELECT xpath, round(ln(n_hrefs + 10) / df * nov * upd, 4) AS score, round(ln(n_hrefs + 10) * nov, 4) AS score_no_df FROM c""")
def rank_enum_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("xpath")).agg(
        F.count_distinct("event_id").alias("n_hrefs"), F.count_distinct("user_id").alias("df"), F.avg("value").alias("avg_novelty"), F.max("value").alias("avg_update")
    )
    c = rank.rank_enum_candidates(e)
    return c.select("xpath", F.round("score", 4).alias("score"), F.round(rank.enum_score_no_df(F.col("n_hrefs"), F.col("avg_novelty")), 4).alias("score_no_df"))


@query("SELECT event_type AS xpath, round(avg(value) * var_pop(value) * count(value), 2) AS score FROM events GROUP BY event_type")
def rank_content_xpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank_content_xpaths(read(spark, sf_dir, "events"), "event_type", "value").select("xpath", F.round("score", 2).alias("score"))


@query("""WITH l AS (SELECT source, length(text) AS t, length(lang) AS p FROM documents), m AS (SELECT source, sum(t + p) / count(*) AS mean, count(*) AS n FROM l GROUP BY source)
    SELECT source, round(any_value(mean) * sum((t - mean) ** 2 + (p - mean) ** 2) / any_value(n) / 1e6, 3) AS score FROM l JOIN m USING (source) GROUP BY source""")
def rank_by_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("source", F.length("text").cast("long").alias("text_len"), F.length("lang").cast("long").alias("path_len"))
    return rank.rank_by_uniqueness(d, ("source",)).select("source", F.round(F.col("score") / 1e6, 3).alias("score"))


@query(f"""WITH c AS (SELECT source, len(list_distinct(list_concat({_TOK}, [lang]))) AS c FROM documents)
    SELECT source, round(avg(c) * var_pop(c), 3) AS score, count(*) AS n_links FROM c GROUP BY source""")
def score_xpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("source", X.tokenize(F.col("text")).alias("text_tokens"), F.array("lang").alias("url_tokens"))
    return decisions.token_scores(d, ("source",)).select("source", F.round("score", 3).alias("score"), "n_links")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page_url"), F.col("event_type").alias("xpath")).agg(F.count("*").cast("double").alias("score"))


_SC = "s AS (SELECT user_id AS page_url, event_type AS xpath, count(*)::DOUBLE AS score FROM events GROUP BY ALL)"


@query(f"""WITH {_SC}, m AS (SELECT *, avg(score) OVER (PARTITION BY page_url) AS mean FROM s), k AS (SELECT * FROM m WHERE score >= mean)
    SELECT page_url, xpath, score, round(avg(score) OVER (PARTITION BY page_url), 6) AS page_score FROM k""")
def above_average_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.above_average(_scores(spark, sf_dir)).select("page_url", "xpath", "score", r6("page_score").alias("page_score"))


@query(f"WITH {_SC} SELECT page_url, xpath, score FROM s QUALIFY row_number() OVER (PARTITION BY page_url ORDER BY score DESC, xpath) = 1")
def richest_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.richest(_scores(spark, sf_dir))


@query("""WITH m AS (SELECT user_id AS page_url, event_type AS xpath, avg(length(props)) AS weight FROM events GROUP BY ALL)
    SELECT page_url, xpath, round(weight, 6) AS weight, row_number() OVER (PARTITION BY page_url ORDER BY weight, xpath)::INTEGER AS place FROM m""")
def weakest_paginator(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("page_url"), F.col("event_type").alias("xpath"), F.array("props").alias("tokens"))
    return decisions.paginators_by_weakness(e).select("page_url", "xpath", r6("weight").alias("weight"), "place")


@query("""WITH m AS (SELECT user_id AS page_url, event_type AS xpath, avg(value) AS score FROM events GROUP BY ALL)
    SELECT page_url, xpath, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY page_url ORDER BY score DESC, xpath) = 1""")
def updated_paginator(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("page_url"), F.col("event_type").alias("xpath"), F.col("value").alias("updated"))
    return decisions.paginator_by_update(e).select("page_url", "xpath", r6("score").alias("score"))


@query("""WITH l AS (SELECT DISTINCT user_id AS page, event_type AS xpath, props AS href, ts < TIMESTAMP '2024-01-15' AS early FROM events)
    SELECT a.page, count(*) FILTER (WHERE b.page IS NULL)::BIGINT AS updated FROM (SELECT * FROM l WHERE early) a
    LEFT JOIN (SELECT * FROM l WHERE NOT early) b ON a.page = b.page AND a.xpath = b.xpath AND a.href = b.href GROUP BY a.page""")
def updated_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_type").alias("xpath"), F.col("props").alias("href"), "ts")
    return decisions.updated(e.filter("ts < timestamp'2024-01-15'"), e.filter("ts >= timestamp'2024-01-15'"))


@query("""WITH s AS (SELECT DISTINCT user_id AS g, event_type AS k, json_extract_string(props, '$.k')::INT // 10 AS i FROM events),
    n AS (SELECT g, k, count(*) AS n FROM s GROUP BY ALL)
    SELECT x.g, x.k AS small, y.k AS large FROM s x JOIN s y ON x.g = y.g AND x.i = y.i AND x.k <> y.k JOIN n ON n.g = x.g AND n.k = x.k GROUP BY x.g, x.k, y.k, n.n HAVING count(*) = n.n""")
def remove_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "events").select(F.col("user_id").alias("g"), F.col("event_type").alias("k"), F.floor(F.get_json_object("props", "$.k").cast("int") / 10).alias("i"))
    return relational.subset_pairs(s, "k", "i", ("g",))


@query("""SELECT event_id, 0.006107788947750795 * value - 0.5526445082337421 * (user_id % 10) + 2.545709699994723 < 0 AS leaf FROM events""")
def leaf_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", classify.is_leaf([F.col("value"), F.col("user_id") % 10]).alias("leaf"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE (n_chars > 600)::INT = quality) AS correct, round(count(*) FILTER (WHERE (n_chars > 600)::INT = quality) / count(*), 6) AS accuracy
    FROM documents JOIN labels USING (doc_id)""")
def leaf_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select((F.col("n_chars") > 600).cast("int").alias("predicted"), F.col("quality").alias("label"))
    return classify.accuracy(d).withColumn("accuracy", r6("accuracy"))


# ------------------------------------------------------------------ paths and models: event sequences stand in


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, actions: all of a user's actions of a day, newest first. seq_id: user times 1000 and the day of the year."""
    seq = (F.col("user_id") * 1000 + F.dayofyear("ts")).cast("long").alias("seq_id")
    newest = F.array_sort(F.collect_list(F.struct((-F.col("event_id")).alias("k"), "event_type")))
    return read(spark, sf_dir, "events").groupBy(seq).agg(F.transform(newest, lambda x: x["event_type"]).alias("actions"))


_SEQ = "q AS (SELECT (user_id * 1000 + dayofyear(ts))::BIGINT AS seq_id, list(event_type ORDER BY event_id DESC) AS actions FROM events GROUP BY 1)"


@query(f"""WITH {_SEQ} SELECT seq_id, k::INTEGER AS k, array_to_string(actions[len(actions) - k + 1 :], '/') AS step, actions[len(actions) - k] AS next
    FROM (SELECT seq_id, actions, unnest(range(len(actions) + 1)) AS k FROM q)""")
def path_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sequences(spark, sf_dir)
    steps = s.select("seq_id", "actions", F.posexplode(P.model_steps(F.col("actions"))).alias("k", "step"))
    return steps.select("seq_id", "k", F.array_join("step", "/").alias("step"), P.action_at(F.col("actions"), F.col("step")).alias("next"))


@query(f"WITH {_SEQ} SELECT array_to_string(actions, '/') AS path, count(*) AS n FROM q GROUP BY actions")
def leaf_path_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = model.path_frequencies(_sequences(spark, sf_dir).withColumnRenamed("actions", "path"))
    return n.select(F.array_join("path", "/").alias("path"), "n")


def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus out of each user's events: page = event, source = the user's event before it, path = its last actions."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = read(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).withColumn("src", F.lag("event_id").over(w)).withColumn("before", F.lag("event_type").over(w))
    path = F.when(F.col("k") == 1, F.array("event_type")).otherwise(F.array("event_type", "before"))
    return e.select(F.col("event_id").cast("string").alias("url"), F.col("src").cast("string").alias("src_url"), F.get_json_object("props", "$.k").alias("src_text"), path.alias("path"), "value")


_WALK = """c AS (SELECT event_id::VARCHAR AS url, lag(event_id) OVER w AS src, lag(event_type) OVER w AS before, event_type AS action, json_extract_string(props, '$.k') AS src_text, value,
    row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    p AS (SELECT c.url, coalesce(c.before, '') AS src_path, c.action, c.src_text, round(1 / (1 + abs(c.value - s.value)), 6) AS sim FROM c JOIN c s ON s.url = c.src::VARCHAR)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _walk(spark, sf_dir)
    src = c.select(F.col("url").alias("b"), F.col("value").alias("vb"))
    sims = c.join(src, c["src_url"] == src["b"]).select(F.col("url").alias("a"), "b", r6(1 / (1 + F.abs(F.col("value") - F.col("vb")))).alias("sim"))
    return model.pagination_candidates(c, sims, 0.3)


@query(f"WITH {_WALK} SELECT url, src_path, action, sim FROM p WHERE sim >= 0.3")
def pagination_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("url", F.array_join("src_path", "/").alias("src_path"), "action", "sim")


@query(f"WITH {_WALK} SELECT src_path, action AS paging_action, sim FROM p WHERE sim >= 0.3 AND regexp_matches(src_text, '^[0-9]+$') QUALIFY row_number() OVER (PARTITION BY src_path ORDER BY sim DESC, action) = 1")
def pagination_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.paging_actions(_pairs(spark, sf_dir)).select(F.array_join("src_path", "/").alias("src_path"), "paging_action", "sim")


@query(f"""WITH {_WALK}, k AS (SELECT src_path, action, count(*) AS n FROM p WHERE sim >= 0.3 GROUP BY ALL)
    SELECT src_path, string_agg(action, ',' ORDER BY action) AS actions FROM k GROUP BY src_path""")
def pagination_in_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.pagination_in_corpus(_pairs(spark, sf_dir)).select(F.array_join("src_path", "/").alias("src_path"), F.array_join("actions", ",").alias("actions"))


@query(f"""WITH {_SEQ}, n AS (SELECT event_type AS action, user_id AS u, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT seq_id, unnest(actions) AS action FROM q)
    SELECT seq_id, 10 * list_reduce(list(n), lambda x, y: x * y) AS yield FROM s JOIN n ON u = seq_id // 1000 AND n.action = s.action GROUP BY seq_id""")
def estimate_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = materialize(_sequences(spark, sf_dir), "sequences")
    page = lambda k: F.concat(F.col("seq_id").cast("string"), F.lit("/"), k.cast("string"))
    n = F.size("actions")
    docs = s.select("seq_id", "actions", F.explode(F.sequence(F.lit(0), n)).alias("k")).select(
        page(F.col("k")).alias("url"), F.when(F.col("k") > 0, page(F.col("k") - 1)).alias("src_url"), F.slice("actions", n - F.col("k") + 1, F.col("k")).alias("path"), (F.col("k") == n).alias("leaf"), F.col("seq_id").alias("_s")
    )
    count = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("_u"), F.col("event_type").alias("action")).agg(F.count("*").alias("n"))
    at = docs.select("url", F.floor(F.col("_s") / 1000).alias("_u")).join(count, "_u").select("url", "action", "n")
    return _yield_by_sequence(s, docs, at, spark.createDataFrame([([],)], "src_path array<string>"))


def _yield_by_sequence(s: DataFrame, docs: DataFrame, n: DataFrame, paging: DataFrame) -> DataFrame:
    """Places of different sequences are kept apart by an action of their own at the start of every path."""
    mark = lambda c, k: F.concat(c, F.array(F.concat(F.lit("#"), k.cast("string"))))
    own = s.withColumn("actions", mark(F.col("actions"), F.col("seq_id")))
    docs = docs.withColumn("path", mark(F.col("path"), F.col("_s")))
    first = s.select(F.lit("root").alias("url"), F.concat(F.lit("#"), F.col("seq_id").cast("string")).alias("action"), F.lit(1).cast("long").alias("n"))
    root = s.select(F.lit("root").alias("url"), F.lit(None).cast("string").alias("src_url"), F.array().cast("array<string>").alias("path"), F.lit(False).alias("leaf")).distinct()
    docs = docs.withColumn("src_url", F.coalesce("src_url", F.lit("root"))).select("url", "src_url", "path", "leaf").unionByName(root)
    return model.estimate_yield(own, docs, n.unionByName(first), paging)


@query(f"WITH {_SEQ} SELECT seq_id, array_to_string(actions, '/') AS actions, row_number() OVER (ORDER BY len(actions), seq_id DESC)::INTEGER AS place FROM q")
def plan_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = model.plan_model(_sequences(spark, sf_dir).withColumn("n", F.col("seq_id")))
    return plan.select("seq_id", F.array_join("actions", "/").alias("actions"), F.col("place").cast("int").alias("place"))


# ------------------------------------------------------------------ traversal: region -> nation -> customer -> order


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer, orders = (read(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    link = lambda df, src, dst, x, o: df.select(src.alias("src"), F.lit(1).alias("rank"), o.cast("int").alias("ord"), F.lit(x).alias("xpath"), dst.alias("href"), o.cast("string").alias("text"))
    c = F.concat
    out = link(nation, c(F.lit("r"), "n_regionkey"), c(F.lit("n"), "n_nationkey"), "//nation", F.col("n_nationkey"))
    out = out.unionByName(link(customer, c(F.lit("n"), "c_nationkey"), c(F.lit("c"), "c_custkey"), "//customer", F.col("c_custkey")))
    return out.unionByName(link(orders, c(F.lit("c"), "o_custkey"), c(F.lit("o"), "o_orderkey"), "//order", F.col("o_orderkey")))


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.seeds(read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("url")))


@query("""SELECT 'r' || r_regionkey AS url, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation
    UNION ALL SELECT 'c' || c_custkey, 2 FROM customer UNION ALL SELECT 'o' || o_orderkey, 3 FROM orders""")
def bfs_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = traverse.crawl(_graph(spark, sf_dir), _starts(spark, sf_dir), per_decision=None)
    return run.visited.select("url", F.size("path").alias("depth"))


@query("""SELECT 'r' || r_regionkey AS url, false AS leaf FROM region UNION ALL SELECT 'n' || n_nationkey, false FROM nation
    UNION ALL (SELECT 'c' || c_custkey, true FROM customer ORDER BY c_nationkey, c_custkey LIMIT greatest(0, 100 - (SELECT count(*) FROM region) - (SELECT count(*) FROM nation)))""")
def replay_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = traverse.replay(_graph(spark, sf_dir), _starts(spark, sf_dir), ["//customer", "//nation"], budget=100)
    return run.visited.select("url", "leaf")


# ------------------------------------------------------------------ idioms


@query("SELECT r_name, n_name FROM region, nation")
def cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.cross_product(read(spark, sf_dir, "region").select("r_name"), read(spark, sf_dir, "nation").select("n_name"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def distinct_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.distinct_by(read(spark, sf_dir, "events"), F.col("user_id"), "event_id").select("user_id", "event_id", "event_type")


@query("""WITH l AS (SELECT user_id, list(event_type ORDER BY event_id) AS t FROM events GROUP BY user_id)
    SELECT user_id, array_to_string(list_reverse(list_transform(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'click'), lambda i: i - 1)), ',') AS places FROM l""")
def positions_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = read(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("t"))
    return seq.select("user_id", F.array_join(P.positions_at(F.col("t"), F.lit("click")).cast("array<string>"), ",").alias("places"))


@query("""SELECT p_partkey, (SELECT count(*) FROM range(1, least(length(p_name), length(p_brand)) + 1) t(i) WHERE left(p_name, i::INT) = left(p_brand, i::INT))::INTEGER AS n FROM part""")
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", P.prefix_match(F.col("p_name"), F.col("p_brand")).alias("n"))


@query("SELECT p_partkey FROM part ORDER BY md5(p_partkey::VARCHAR || ':1'), p_partkey LIMIT 25")
def sample_random_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.random_take(read(spark, sf_dir, "part").select("p_partkey"), 25, "p_partkey")


@query("""SELECT p_partkey FROM (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_size, p_partkey) / (SELECT sum(p_size) FROM part) AS c FROM part) WHERE c >= 0.37 ORDER BY c LIMIT 1""")
def sample_proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    return relational.sample_proportional(p, "p_size", 0.37, "p_partkey").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def anti_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


_MERGE = "SELECT coalesce(a.k, b.k) AS k, coalesce({}) AS v FROM (SELECT c_custkey AS k, c_name AS v FROM customer) a FULL JOIN (SELECT s_suppkey AS k, s_name AS v FROM supplier) b ON a.k = b.k"


def _merge(spark: SparkSession, sf_dir: str, last: bool) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return relational.merge_maps([a, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))], ["k"], last)


@query(_MERGE.format("b.v, a.v"))
def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, True)


@query(_MERGE.format("a.v, b.v"))
def merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, False)


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY ALL) a
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY ALL) b ON a.k = b.k""")
def full_outer_merge_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return relational.merge_with(a, b, ["k"], "n", lambda x, y: x + y)


@query("""WITH l AS (SELECT conv_id, list(length(text) ORDER BY turn) AS v FROM conversations GROUP BY conv_id), m AS (SELECT min(len(v)) AS n FROM l)
    SELECT pos::INTEGER AS pos, sum(v[pos + 1])::BIGINT AS total, count(*) AS n FROM (SELECT v, unnest(range(m.n)) AS pos FROM l, m) GROUP BY pos""")
def positional_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))), lambda x: x["n"]).alias("v"))
    t = relational.transpose(c, "conv_id", "v")
    return t.select("pos", F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("values").cast("long").alias("n"))


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def mode_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    top = model.most_frequent(e.select("user_id", "event_type"), ("user_id",), ("event_type",))
    return top.join(e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id", "event_type"])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id AS a, 1000000 + event_id AS b FROM events), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT DISTINCT a AS id, a AS o FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.o) SELECT id, min(o) AS component FROM r GROUP BY id""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.operators.components import connected_components

    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("a"), (1000000 + F.col("event_id")).alias("b"))
    return connected_components(e)


from linkloom import operator_queries  # noqa: E402, F401  (adds its queries)

"""What is held at once does not grow with the input."""

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
from linkloom.operators import similarity as S
from linkloom.plans import model as M
from linkloom.sources import html as H

PAGE = "<body>" + "<p>some text<br></p>" * 200


def first_of(run, batch, made):
    """Rows made until the first result comes out, and rows of all results."""
    out = run(iter([batch]))
    n = next(out).num_rows
    early = len(made)
    return early, n + sum(b.num_rows for b in out)


def test_few_pages_are_parsed_at_once(spark, monkeypatch):
    """A worker held what was made of all pages of a batch, 64 MB of them, which takes many times as much."""
    taken, made = [], []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, schema: taken.append(run))
    pages = spark.createDataFrame([], "page_url string, _html string")
    H._mapped(pages, lambda s: made.append(1) or H.nodes_of(s), "_nodes", H.T.ArrayType(H.NODE), ("_html",))
    batch = pa.RecordBatch.from_pydict({"page_url": ["u"] * 600, "_html": [PAGE] * 599 + [None]})
    early, rows = first_of(taken[0], batch, made)
    assert rows == 600 and early * len(PAGE) <= 2 * H.AT_ONCE
    assert made.clear() or S.tree_similarity(spark.createDataFrame([], "html_a string, html_b string")) is None
    monkeypatch.setattr(S, "tree_similarity_of", lambda a, b: made.append(1) or 1.0)
    early, rows = first_of(taken[1], pa.RecordBatch.from_pydict({"html_a": [PAGE] * 600, "html_b": [PAGE] * 600}), made)
    assert rows == 600 and 2 * early * len(PAGE) <= 2 * H.AT_ONCE
    assert sum(b.num_rows for b in taken[0](iter([batch.slice(0, 0)]))) == 0


def plain_pairs(rows):
    """a, b: (cosine or None, cardinality) of pages that share an action, pair by pair."""
    sig = defaultdict(list)
    for page, xpath, n in rows:
        sig[page].append((xpath, n))
    norm = {p: math.sqrt(sum((n or 0) ** 2 for _, n in v)) for p, v in sig.items()}
    out = {}
    for a in sig:
        for b in sig:
            shared = [(m or 0) * (n or 0) for x, m in sig[a] for y, n in sig[b] if x == y]
            if a < b and shared:
                d = norm[a] * norm[b]
                out[a, b] = (round(sum(shared) / d, 9) if d else None, round(len(shared) / math.sqrt(len(sig[a]) * len(sig[b])), 9))
    return out


def test_signature_pairs_are_neither_joined_nor_shuffled(spark, monkeypatch):
    """Every pair was a row of a join for each action that it shares, and all were dealt by pair."""
    rng = random.Random(5)
    rows = [(f"p{i:03}", f"x{x}", rng.choice([0, 1, 2, 5])) for i in range(60) for x in rng.sample(range(40), rng.randint(1, 6))]
    rows += [("zero", "x1", 0), ("twice", "x2", 1), ("twice", "x2", 3), ("alone", "none", 2), ("é", "x3", 4)]
    sig = spark.createDataFrame([*rows, (None, "x1", 1)], "page string, xpath string, n long")
    for block in (7, 1024):
        monkeypatch.setattr(S, "BLOCK", block)
        got = S.signature_similarities(sig)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert 0 < plan.index("MapInArrow") < plan.index("Exchange") and "Join" not in plan
        found = [((r.a, r.b), (r.cosine and round(r.cosine, 9), round(r.cardinality, 9))) for r in got.collect()]
        assert len(found) == len(dict(found)) and dict(found) == plain_pairs(rows)
    assert S.signature_similarities(sig.limit(0)).count() == 0


def test_signature_cells_of_many_actions(monkeypatch):
    """Matrices of a cell are made for so many actions and left pages at once."""
    monkeypatch.setattr(S, "ACTIONS", 3)
    monkeypatch.setattr(S, "STRIP", 2)
    rng = random.Random(6)
    rows = [(i, f"x{x}", rng.randint(1, 5)) for i in range(12) for x in rng.sample(range(20), 5)]
    for side in (lambda i: False, lambda i: i >= 7):
        v = [[{"xpath": x, "n": float(n)} for q, x, n in rows if q == i] for i in range(12)]
        norm = [math.sqrt(sum(e["n"] ** 2 for e in x)) for x in v]
        cols = {"cell": [0] * 12, "side": [side(i) for i in range(12)], "page": list(range(12)), "norm": norm, "size": [5.0] * 12, "v": v}
        batch = pa.RecordBatch.from_pydict(cols)
        got = {(r["a"], r["b"]): (round(r["cosine"], 9), round(r["cardinality"], 9)) for b in S._compared([batch.slice(0, 4), batch.slice(4)]) for r in b.to_pylist()}
        assert got == {k: x for k, x in plain_pairs(rows).items() if side(11) is False or not side(k[0]) and side(k[1])}


def test_near_duplicates_move_prefixes_only(spark, monkeypatch):
    """Whole sets were written twice and dealt out four times; and a passage of many texts makes no candidates."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    common = " ".join(rng.choices(words, k=60))
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 300))) for _ in range(150)]
    texts += [f"{common} {' '.join(rng.choices(words, k=40))}" for _ in range(40)]
    for t in rng.sample(texts, 40):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), t]
    texts += ["", "a b c", common, common]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    made = []

    def written(df, name):
        out = S_materialize(df, name)
        made.append((name, sum(f.stat().st_size for f in Path(out._scratch.removeprefix("file:")).glob("*.parquet"))))
        return out

    S_materialize = S.materialize
    monkeypatch.setattr(S, "materialize", written)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for num, den in ((9, 10), (1, 2)):
        got = {(r.a, r.b): (r.inter, r.size_a, r.size_b) for r in S.near_duplicate_pairs(docs, num=num, den=den).collect()}
        alike = {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] & sets[b]}
        assert got == {k: v for k, v in alike.items() if den * v[0] >= num * (v[1] + v[2] - v[0])}
    one = made[: len(made) // 2]
    assert sum(n for _, n in one) < 1.4 * dict(one)["shingles"]
    pre = S._prefixes(S._hashed(docs, "doc_id", "text", 4).select("set", "h"), 9, 10).collect()
    assert max(Counter(r.gram for r in pre if r.size > 90).values()) <= 2 * S.OFTEN


def test_ancestors_are_numbers(spark, monkeypatch):
    """Every round of the doubling wrote and dealt out addresses and paths of pages and of those above them."""
    tables = {}
    real = M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, name: tables.setdefault(name, []).append(df.dtypes) or real(df, name))
    seqs = spark.createDataFrame([(1, ["c", "b", "a"]), (2, ["b", "a"]), (3, ["x"])], "seq_id long, actions array<string>")
    rows = [("r", None, [], False), ("p", "r", ["a"], False), ("p", "r2", ["a"], False), ("q", "p", ["b", "a"], True), ("q", "p", ["b", "a"], False), ("s", "q", ["c", "b", "a"], True), ("t", "gone", ["x"], True)]
    docs = spark.createDataFrame(rows, "url string, src_url string, path array<string>, leaf boolean")
    n = spark.createDataFrame([("r", "a", 2), ("p", "b", 3), ("q", "c", 5), ("t", "x", 7)], "url string, action string, n long")
    assert {r.seq_id: r["yield"] for r in M.estimate_yield(seqs, docs, n).collect()} == {1: 30, 2: 6, 3: 0}
    assert len(tables["hops"]) > 1 and {t for name in ("hops", "reach") for dtypes in tables[name] for _, t in dtypes} == {"bigint"}

"""Near duplicates by shingles, page signatures, structural similarity and tree edit similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.text import shingles
from linkloom.sources.html import Node, dom_nodes, parse, parts
from linkloom.sources.scratch import bounded_batches, materialize

from .relational import numbered

# ---------------------------------------------------------------- shingles


def shingle_table(docs: DataFrame, key: str, text: str, k: int = 4) -> DataFrame:
    """One row a document and distinct shingle."""
    return docs.select(F.col(key).alias("doc"), F.explode(shingles(F.col(text), k)).alias("gram"))


def shingle_counts(docs: DataFrame, key: str, text: str, k: int = 4) -> DataFrame:
    return docs.select(key, F.size(shingles(F.col(text), k)).cast("long").alias("n_shingles"))


def _hashed(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """doc, h (sorted hashes of its shingles) and set (a 128-bit name of those); documents without shingles left out."""
    h = F.array_sort(F.array_distinct(F.transform(shingles(F.col(text), k), lambda g: F.xxhash64(g))))
    own = docs.select(F.col(key).alias("doc"), h.alias("h")).filter(F.size("h") > 0)
    return own.withColumn("set", F.unhex(F.md5(F.array_join(F.transform("h", lambda x: x.cast("string")), ",").cast("binary"))))


#: Grams in more prefixes than this come last in the order, and rounds in which such are looked for. Both only save
#: work: prefixes of any order find all similar sets.
OFTEN, ROUNDS = 16, 4
#: Numbers of 64 bits that go to every task at once, at most.
SHARED = 4_000_000


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Members of a batch's sets one after another, and the number of each set's."""
    h = batch.column(batch.schema.get_field_index("h"))
    return pc.list_flatten(h).to_numpy(zero_copy_only=False), pc.list_value_length(h).to_numpy(zero_copy_only=False).astype(np.int64)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each number is one of the sorted ones."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _prefix_rows(sets: DataFrame, num: int, den: int, often: np.ndarray) -> DataFrame:
    """Rows set, size, gram: the first grams of each set (seldom ones first, then by hash), one of which any similar set
    shares. Where a set has several rows, so have its grams."""
    known = sets.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = _lists(b)
            row = np.repeat(np.arange(len(n)), n)
            order = np.argsort(row * 2 + _among(x, known.value), kind="stable")
            place = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            keep = order[place < np.repeat(n - (n * num + den - 1) // den + 1, n)]
            of = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), pa.array(n[row[keep]].astype(np.int32)), pa.array(x[keep])], names=["set", "size", "gram"])

    return sets.select("set", "h").mapInArrow(run, "set binary, size int, gram long")


def _prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """_prefix_rows() of an order in which grams of many sets' prefixes come last, as far as SHARED allows.

    Only prefixes are counted, a tenth of all grams for nine tenths of similarity; what moves up instead of a frequent
    gram is looked at in the next round.
    """
    often = np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        rows = _prefix_rows(sets, num, den, often).select("gram", F.xxhash64("set").alias("s"))
        # Several sets, not copies of one.
        n = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("s").alias("x"), F.max("s").alias("y")).filter((F.col("n") > OFTEN) & (F.col("x") != F.col("y")))
        found = np.array(n.orderBy(F.desc("n"), "gram").limit(SHARED).select("gram").toArrow().column(0).to_numpy(), np.int64)
        new = found[~_among(found, often)][: SHARED - len(often)]
        if not len(new):
            break
        often = np.sort(np.concatenate((often, new)))
    return _prefix_rows(sets, num, den, often)


def _parities(sets: DataFrame) -> DataFrame:
    """set, n and bits: parities of the members in 2**j cells, as many as members or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = _lists(b)
            end = np.cumsum(n)
            # The hashes' own bits: they are as good as random.
            cells = [(x[j - k : j] & (max(64, 1 << int(k - 1).bit_length()) - 1), max(64, 1 << int(k - 1).bit_length())) for j, k in zip(end, n)]
            bits = [np.packbits(np.bincount(c, minlength=m) & 1, bitorder="little").tobytes() for c, m in cells]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(bits, pa.binary())], names=["set", "n", "bits"])

    return sets.select("set", "h").mapInArrow(run, "set binary, n long, bits binary").dropDuplicates(["set"])


def bits_apart(a: bytes, b: bytes) -> int:
    """Cells in which two parities differ, the longer one folded onto the shorter: at most the members of only one set."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _plausible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that parities do not rule out; exact: similar sets differ in (na + nb) * (den - num) / (den + num)
    members at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [bits_apart(x, y) * (den + num) <= (m + n) * (den - num) for m, n, x, y in zip(*(c.to_pylist() for c in b.columns[2:]))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    p = _parities(sets)
    full = pairs.join(p.select(F.col("set").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x")), "a").join(p.select(F.col("set").alias("b"), "n", F.col("bits").alias("y")), "b")
    return full.select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a binary, b binary")


def _named(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """set and h of the sets in pairs, each once. Other sets are left out where they lie, as far as SHARED names tell."""
    names = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    own = names.select(F.xxhash64("set").alias("s")).limit(SHARED + 1).toArrow().column(0).to_numpy()
    picked = sets.select("set", "h")
    if len(own) <= SHARED:
        known = sets.sparkSession.sparkContext.broadcast(np.sort(own))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.select(["set", "h"]).filter(pa.array(_among(b.column(2).to_numpy(), known.value)))

        picked = picked.withColumn("s", F.xxhash64("set")).mapInArrow(run, "set binary, h array<long>")
    return picked.dropDuplicates(["set"])


def near_duplicate_sets(
    left: DataFrame, right: DataFrame | None = None, key: str = "doc_id", text: str = "text", k: int = 4, num: int = 9, den: int = 10, right_key: str | None = None, right_text: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names, names of right, links): doc and set of every document with shingles; a < b, inter, na, nb of different
    sets that are alike by num/den or more (exact whole numbers; shingles are compared by 64-bit hashes).

    Texts are read once, and sets stay where they lie: only prefixes of them are joined, in which frequent shingles come last;
    parities rule out most candidates, and whole sets travel for the rest. Equal sets are one set, so copies make no links.
    """
    own = materialize(_hashed(left, key, text, k), "shingles")
    other = own if right is None else materialize(_hashed(right, right_key or key, right_text or text, k), "shingles")
    every = bounded_batches(own.select("set", "h") if right is None else own.select("set", "h").unionByName(other.select("set", "h")))
    # Dealt by gram once, for both sides.
    pre = _prefixes(every, num, den).repartition("gram").dropDuplicates(["gram", "set"])
    x, y = pre.alias("x"), pre.alias("y")
    near = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.set") < F.col("y.set")) & (F.col("x.size") * den >= F.col("y.size") * num) & (F.col("y.size") * den >= F.col("x.size") * num)
    cand = x.join(y, near).select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct()
    cand = materialize(_plausible(cand, every, num, den), "candidates")
    sets = _named(every, cand)
    full = cand.join(sets.select(F.col("set").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("set").alias("b"), F.col("h").alias("hb")), "b")
    full = full.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("inter"), F.size("ha").alias("na"), F.size("hb").alias("nb"))
    links = full.filter(den * F.col("inter") >= num * (F.col("na") + F.col("nb") - F.col("inter")))
    return own.select("doc", "set", F.size("h").alias("n")), other.select("doc", "set", F.size("h").alias("n")), materialize(links, "links")


def near_duplicate_pairs(left: DataFrame, right: DataFrame | None = None, key: str = "doc_id", text: str = "text", k: int = 4, num: int = 9, den: int = 10, right_key: str | None = None, right_text: str | None = None) -> DataFrame:
    """a, b, inter, size_a, size_b of documents whose shingle sets are alike by num/den or more; without `right`, a < b.

    All pairs, those of copies too: n copies are n * n / 2 rows. Where membership will do, use near_duplicate_sets().
    """
    own, other, links = near_duplicate_sets(left, right, key, text, k, num, den, right_key, right_text)
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"), "inter", F.col("nb").alias("na"), F.col("na").alias("nb"))
    a, b = own.select(F.col("doc").alias("doc_a"), F.col("set").alias("a"), "n"), other.select(F.col("doc").alias("doc_b"), F.col("set").alias("b"))
    same = a.join(b, F.col("a") == F.col("b")).select("doc_a", "doc_b", F.col("n").alias("inter"), F.col("n").alias("na"), F.col("n").alias("nb"))
    out = links.unionByName(back).join(a.drop("n"), "a").join(b, "b").select("doc_a", "doc_b", "inter", "na", "nb").unionByName(same)
    if right is None:
        out = out.filter("doc_a < doc_b")
    c = lambda n: F.col(n).cast("long")
    return out.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), c("inter").alias("inter"), c("na").alias("size_a"), c("nb").alias("size_b"))


def seen(docs: DataFrame, corpus: DataFrame, key: str = "doc_id", text: str = "text", corpus_key: str = "item_id", corpus_text: str = "text") -> DataFrame:
    """Documents that are near duplicates of any in the corpus; no pairs of documents are made."""
    own, other, links = near_duplicate_sets(docs, corpus, key, text, right_key=corpus_key, right_text=corpus_text)
    known = other.select("set").distinct()
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hit = both.join(known.withColumnRenamed("set", "b"), "b").select(F.col("a").alias("set")).unionByName(known).distinct()
    return docs.join(own.join(hit, "set", "left_semi").select(F.col("doc").alias(key)).distinct(), key, "left_semi")


# ---------------------------------------------------------------- signatures: tables (page, xpath, n)


def page_signature(links: DataFrame, vocabulary: DataFrame, page: str = "page", xpath: str = "xpath") -> DataFrame:
    """Links by page and chosen action, 0 where a page has none."""
    counts = links.groupBy(page, xpath).agg(F.count("*").alias("n"))
    grid = links.select(page).distinct().crossJoin(vocabulary.select(xpath).distinct())
    return grid.join(counts, [page, xpath], "left").select(page, xpath, F.coalesce("n", F.lit(0)).alias("n"))


#: Pages of a block (a cell compares two blocks), left pages compared at once, and actions of a cell taken at once.
BLOCK, STRIP, ACTIONS = 1024, 128, 4096


def _cells(sig: DataFrame) -> DataFrame:
    """cell, side, page, norm, size, v sorted by cell: every two blocks of pages, side by side in the pages' order."""
    v = F.collect_list(F.when(F.col("xpath").isNotNull(), F.struct("xpath", F.col("n").cast("double").alias("n"))))
    per = sig.filter("page is not null").groupBy("page").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.count("*").cast("double").alias("size"), v.alias("v"))
    own = materialize(numbered(per, [F.col("page")], "no"), "signatures").withColumn("block", F.floor((F.col("no") - 1) / BLOCK))
    blocks = own.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1))))
    cell = F.least("block", "other") * blocks + F.greatest("block", "other")
    n = blocks * (blocks + 1) // 2
    # Few bytes go in and many rows come out, so that tasks are not merged by their bytes.
    tasks = max(1, min(n, max(int(sig.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 16)))
    rows = other.select(cell.alias("cell"), (F.col("block") > F.col("other")).alias("side"), "no", "page", "norm", "size", "v")
    return rows.repartition(tasks, "cell").sortWithinPartitions("cell", "side", "no").drop("no")


def _compared(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of one cell that share an action, a strip of its left pages at a time."""
    t = pa.Table.from_batches(rows).combine_chunks()
    side = t["side"].to_numpy()
    left, right = np.flatnonzero(~side), np.flatnonzero(side)
    alone = not len(right)
    right = left if alone else right
    lists = pc.fill_null(pc.list_value_length(t["v"]), 0).to_numpy().astype(np.int64)
    flat = pc.list_flatten(t["v"]).combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    code = flat.field("xpath").dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = pc.fill_null(flat.field("n"), 0.0).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(lists)), lists)
    norm = pc.fill_null(t["norm"].cast(pa.float64()), 0.0).to_numpy()
    size = np.sqrt(t["size"].to_numpy())
    pages = t["page"].combine_chunks()
    width = int(code.max(initial=-1)) + 1

    def dense(who: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Amounts and numbers of the actions from `low` on of some pages."""
        place = np.full(len(lists), -1)
        place[who] = np.arange(len(who))
        use = np.flatnonzero((place[of] >= 0) & (code >= low) & (code < low + ACTIONS))
        out = np.zeros((2, len(who), min(ACTIONS, width - low)))
        np.add.at(out[0], (place[of[use]], code[use] - low), n[use])
        np.add.at(out[1], (place[of[use]], code[use] - low), 1.0)
        return out[0], out[1]

    whole = dense(right, 0) if width <= ACTIONS else None
    for s in range(0, len(left), STRIP):
        mine = left[s : s + STRIP]
        dot, shared = np.zeros((2, len(mine), len(right)))
        for low in range(0, width, ACTIONS):
            x, y = dense(mine, low), whole or dense(right, low)
            dot += x[0] @ y[0].T
            shared += x[1] @ y[1].T
        met = shared > 0
        if alone:
            met &= np.arange(len(right)) > np.arange(s, s + len(mine))[:, None]
        i, j = np.nonzero(met)
        if not len(i):
            continue
        a, b = mine[i], right[j]
        both = norm[a] * norm[b]
        none = both == 0
        cosine = pa.array(dot[i, j] / np.where(none, 1.0, both), mask=none)
        cols = [pages.take(pa.array(a)), pages.take(pa.array(b)), cosine, pa.array(shared[i, j] / (size[a] * size[b]))]
        yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=["a", "b", "cosine", "cardinality"])


def signature_similarities(sig: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """a < b, cosine, cardinality and similarity (their product) of pages that share an action; weights: xpath, weight.

    Pages are numbered in order and cut into blocks; every two blocks meet in a cell, where products of their matrices
    give all pairs at once. Pairs are the result and are neither joined nor shuffled; a worker holds two blocks and a strip of pairs.
    """
    if weights is not None:
        sig = sig.join(weights, "xpath").withColumn("n", F.col("n") * F.col("weight"))
    cells = _cells(sig.select("page", "xpath", "n"))
    kind = sig.schema["page"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            cell = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if held and cell[x] != now:
                    yield from _compared(held)
                    held = []
                now = cell[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield from _compared(held)

    fields = [T.StructField("a", kind), T.StructField("b", kind), T.StructField("cosine", T.DoubleType()), T.StructField("cardinality", T.DoubleType())]
    pairs = bounded_batches(cells).mapInArrow(run, T.StructType(fields))
    return pairs.withColumn("similarity", F.col("cosine") * F.col("cardinality"))


def weights_table(links: DataFrame, xpath: str = "xpath", href: str = "href", page: str = "page") -> DataFrame:
    """weight of each action: ln(distinct links) over the pages that show it."""
    return links.groupBy(F.col(xpath).alias("xpath")).agg((F.ln(F.count_distinct(href)) / F.count_distinct(page)).alias("weight"))


def signature_distance(a: DataFrame, b: DataFrame, ins: float = 1.0, dele: float = 1.0, on: tuple[str, ...] = ()) -> DataFrame:
    """Edit distance and similarity of signatures (xpath, n), and their Manhattan distance; `on`: columns that pair them."""
    keys = [*on, "xpath"]
    both = a.select(*keys, F.col("n").alias("h1")).join(b.select(*keys, F.col("n").alias("h2")), keys, "full_outer").fillna(0, ["h1", "h2"])
    d = dele * F.greatest(F.col("h1") - F.col("h2"), F.lit(0)) + ins * F.greatest(F.col("h2") - F.col("h1"), F.lit(0))
    agg = both.groupBy(*on) if on else both.groupBy()
    out = agg.agg(F.sum(d).alias("distance"), F.sum(dele * F.col("h1") + ins * F.col("h2")).alias("_all"), F.sum(F.abs(F.col("h1") - F.col("h2"))).alias("manhattan"))
    return out.withColumn("similarity", 1 - F.try_divide(F.col("distance").cast("double"), F.col("_all").cast("double"))).drop("_all")


def rank_by_potential(links: DataFrame, page: str = "page_url") -> DataFrame:
    """Actions by their number of links, most first."""
    n = links.groupBy(page, "xpath").agg(F.count("*").alias("n"))
    return n.orderBy(page, F.desc("n"), "xpath")


# ---------------------------------------------------------------- structure


def xpath_chars(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Characters of text by page and path of the element that holds it: page_url, xpath, n_chars."""
    from linkloom.functions.paths import action_of

    n = dom_nodes(pages, html, url).withColumn("n", F.length(F.trim("text"))).filter("n > 0")
    return n.groupBy("page_url", action_of(F.col("path")).alias("xpath")).agg(F.sum("n").cast("long").alias("n_chars"))


def structural_similarity(chars: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with sim: the cosine of their pages' xpath-to-characters maps (null without text on either)."""
    v = chars.select("page_url", "xpath", F.col("n_chars").cast("double").alias("n"))
    norm = v.groupBy("page_url").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    p = pairs.select("a", "b").distinct()
    dot = p.join(v.select(F.col("page_url").alias("a"), "xpath", F.col("n").alias("na")), "a").join(v.select(F.col("page_url").alias("b"), "xpath", F.col("n").alias("nb")), ["b", "xpath"])
    dot = dot.groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    out = p.join(dot, ["a", "b"], "left").join(norm.select(F.col("page_url").alias("a"), F.col("norm").alias("x")), "a", "left").join(norm.select(F.col("page_url").alias("b"), F.col("norm").alias("y")), "b", "left")
    return out.select("a", "b", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.try_divide(F.coalesce("dot", F.lit(0.0)), F.col("x") * F.col("y"))).alias("sim"))


def similar_pairs(chars: DataFrame, pairs: DataFrame, least: float = 0.8) -> DataFrame:
    """The pairs that are structurally similar."""
    return structural_similarity(chars, pairs).filter(F.col("sim") >= least)


def like_example(chars: DataFrame, example: DataFrame, least: float = 0.8) -> DataFrame:
    """page_url and leaf: whether a page is structurally similar to the example (xpath, n_chars of one page)."""
    e = example.agg(F.map_from_entries(F.collect_list(F.struct("xpath", F.col("n_chars").cast("double")))).alias("_e"))
    v = chars.groupBy("page_url").agg(F.collect_list(F.struct("xpath", F.col("n_chars").cast("double").alias("n"))).alias("v"))
    # One page: a bounded row.
    both = v.join(F.broadcast(e), how="cross")
    sq = lambda arr: F.sqrt(F.aggregate(arr, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate("v", F.lit(0.0), lambda s, x: s + x["n"] * F.coalesce(F.try_element_at(F.col("_e"), x["xpath"]), F.lit(0.0)))
    sim = F.try_divide(dot, sq(F.transform("v", lambda x: x["n"])) * sq(F.map_values("_e")))
    return both.select("page_url", F.coalesce(sim >= least, F.lit(False)).alias("leaf"))


# ---------------------------------------------------------------- tree edit similarity


class _Tree:
    """A parsed page with descendants counted and subtrees numbered by shape, so that equality is one comparison."""

    def __init__(self, node: Node, shapes: dict):
        self.tag = node.tag
        self.kids: list[_Tree] = []
        parts: list = []
        for c in node.children:
            if isinstance(c, str):
                parts.append(c)
            else:
                t = _Tree(c, shapes)
                self.kids.append(t)
                parts.append(t.shape)
        self.size = sum(k.size + 1 for k in self.kids)
        self.shape = shapes.setdefault((node.tag, tuple(sorted(node.attrs.items())), tuple(parts)), len(shapes))


def tree_edit_distance(a: _Tree, b: _Tree, dele: int = 1, ins: int = 1, sub: int = 1, memo: dict | None = None) -> int:
    """Restricted top-down distance of two trees' children. Every cell of the table starts at the cost of removing all
    of one and adding all of the other; a pair of children then saves both when equal, what is alike below when of one
    tag, and costs a substitution otherwise."""
    memo = {} if memo is None else memo
    key = (id(a), id(b))
    if key not in memo:
        m, n = len(a.kids), len(b.kids)
        every = dele * a.size + ins * b.size
        above = [every] * (n + 1)
        for x in a.kids:
            row = [every]
            for j, y in enumerate(b.kids):
                cut = above[j] - dele - ins
                if x.shape == y.shape:
                    cut -= ins * y.size + dele * x.size
                elif x.tag == y.tag:
                    cut -= dele * x.size + ins * y.size - tree_edit_distance(x, y, dele, ins, sub, memo)
                else:
                    cut += sub
                row.append(min(above[j + 1], row[j], cut))
            above = row
        memo[key] = above[n]
    return memo[key]


def tree_similarity_of(a: str | None, b: str | None) -> float | None:
    """1 - distance / descendants of both, 0 with a page missing, null where neither root has descendants."""
    if a is None or b is None:
        return 0.0
    shapes: dict = {}
    x, y = (_Tree(parse(s, frozenset()), shapes) for s in (a, b))
    return None if x.size + y.size == 0 else 1 - tree_edit_distance(x, y) / (x.size + y.size)


def tree_similarity(pairs: DataFrame, a: str = "html_a", b: str = "html_b", out: str = "sim") -> DataFrame:
    """pairs with the tree edit similarity of two page columns."""
    pairs = pairs.drop(out)
    i, j = pairs.columns.index(a), pairs.columns.index(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, [i, j]):
                sims = [tree_similarity_of(x, y) for x, y in zip(part.column(i).to_pylist(), part.column(j).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sims, pa.float64())], names=[*part.schema.names, out])

    return bounded_batches(pairs).mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField(out, T.DoubleType())]))


def tree_similarity_of_links(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """Pairs of addresses (a, b) through a page store (url, html); a missing page gives 0."""
    store = pages.select("url", "html").dropDuplicates(["url"])
    full = pairs.join(store.select(F.col("url").alias("a"), F.col("html").alias("html_a")), "a", "left").join(store.select(F.col("url").alias("b"), F.col("html").alias("html_b")), "b", "left")
    return tree_similarity(full).drop("html_a", "html_b")


def is_similar(sim: Column, least: float = 0.8) -> Column:
    return F.coalesce(sim >= least, F.lit(False))

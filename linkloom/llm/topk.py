"""Exact top-k inner products with block-at-a-time pruning.

Vectors are ordered by the nearest of some pivots (a bounded sample of the vectors), then by key, and cut into blocks of
`block` documents, so that a block holds vectors that are alike; a block's forward index is its matrix. For every
dimension ("term") a block keeps its largest and smallest component, so sum(max(q*top, q*low)) bounds the score of
all its documents for a query q. Each query visits a range's blocks by falling bound and stops when no bound left
reaches its k-th score (an equal bound may still win by its key). Partial results of the ranges are merged.

Queries come in chunks and candidates in ranges, each of bounded size, and meet as cells of a grid: nothing else is
broadcast, no task holds more than one chunk and one range, and only k rows a query leave a cell. A first round over one
range gives every query a k-th score to start from. Then only the ranges' tops and lows travel, a page of them at a
time, and tell which cells can still win; vectors travel to those alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

BLOCK, RANGE, CHUNK = 64, 2048, 2048
#: Vectors sampled as pivots (by a hash of their keys), and ranges on a page of summaries.
PIVOTS, PAGE = 256, 2048
#: Below every score (and its negative is a number, unlike that of the least integer).
NONE = -(1 << 62)
MATRIX = "n long, ids binary, data binary, dim int, tops binary, lows binary"
HITS = "query_id long, vec_id long, score long"


def quantise(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """_id, _v (array of long): floor(scale * x); rows with a null vector, component or non-finite value, or a null key,
    take no part. A vector without components is one of zeros."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    doubles = F.transform(vector, lambda x: x.cast("double"))
    whole = vectors.select(F.col(key).cast("long").alias("_id"), doubles.alias("_d")).filter(F.col("_id").isNotNull() & F.col("_d").isNotNull() & F.forall("_d", good))
    return whole.select("_id", F.transform("_d", lambda x: F.floor(x * scale)).alias("_v"))


def _padded(vecs: list[list[int]]) -> np.ndarray:
    m = np.zeros((len(vecs), max(1, *map(len, vecs)) if vecs else 1), np.int64)  # a shorter vector ends in zeros
    for i, v in enumerate(vecs):
        m[i, : len(v)] = v
    return m


def pivots_of(vectors: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """Up to `most` vectors, brought to length one and ordered so that neighbours are alike."""
    got = vectors.select("_id", "_v").orderBy(F.xxhash64("_id"), "_id").limit(most).collect()
    if not got:
        return np.zeros((1, 1))
    m = _padded([r._v for r in got]).astype(np.float64)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    left, chain = list(range(1, len(m))), [0]
    while left:
        best = int(np.argmax(m[left] @ m[chain[-1]]))
        chain.append(left.pop(best))
    return m[chain]


def nearest(pivots: np.ndarray, m: np.ndarray) -> np.ndarray:
    dim = min(pivots.shape[1], m.shape[1])
    return np.argmax(m[:, :dim].astype(np.float64) @ pivots[:, :dim].T, axis=1)


def _placed(df: DataFrame, pivots) -> DataFrame:
    """Adds _c, the place of the nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = nearest(pivots.value, _padded(b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c.astype(np.int64))], names=["_id", "_v", "_c"])

    return df.select("_id", "_v").mapInArrow(run, "_id long, _v array<long>, _c long")


def _packed(df: DataFrame, most: int, name: str) -> DataFrame:
    """Rows of `most` vectors at most, by pivot and key, numbered by groups of about `most` vectors: `group`. tops and
    lows: the largest and smallest of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vecs: list[list[int]] = []

        def out() -> pa.RecordBatch:
            m = _padded(vecs)
            row = [[len(ids)], [np.array(ids, np.int64).tobytes()], [m.tobytes()], [m.shape[1]], [m.max(0).tobytes()], [m.min(0).tobytes()]]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=["n", "ids", "data", "dim", "tops", "lows"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                vecs.append(v)
                if len(ids) == most:
                    yield out()
                    ids, vecs = [], []
        if ids:
            yield out()

    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(n, "_c", "_id").sortWithinPartitions("_c", "_id")
    rows = materialize(ordered.select("_id", "_v").mapInArrow(run, MATRIX).withColumn("row", F.monotonically_increasing_id()), name)
    # One small record a matrix; only these are numbered together.
    upto = F.sum("n").over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    groups = rows.select("row", "n").withColumn("group", F.floor((upto - F.col("n")) / most)).drop("n")
    return rows.join(groups, "row")


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], np.int64).reshape(-1, row["dim"])


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers: by floats where every partial sum is exact in them, else by 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounds_of(q: np.ndarray, tops: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """The most that a vector between lows and tops can score for each query."""
    up = np.maximum(q, 0)
    return _exact(up, tops) + _exact(q - up, lows)


def search_cell(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, block: int = BLOCK, seen: list | None = None) -> list[tuple[int, int, int]]:
    """(query, key, score) of each query's best k in one range, those only that can reach its floor. seen: takes the number
    of (query, block) pairs that were scored.

    Scored block by block: in each step every query that still has a bound to beat takes its next best block, and
    queries that take the same block are scored together.
    """
    dim = max(q.shape[1], m.shape[1])
    q, m = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, m))
    cuts = list(range(0, len(ids), block))
    tops = np.stack([m[c : c + block].max(0) for c in cuts])
    lows = np.stack([m[c : c + block].min(0) for c in cuts])
    bounds = bounds_of(q, tops, lows)
    visit = np.argsort(-bounds, axis=1, kind="stable")
    best_s = np.full((len(q), k), NONE)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    need = floors.copy()
    live = np.arange(len(q))
    for step in range(len(cuts)):
        at = visit[live, step]
        going = bounds[live, at] >= need[live]
        live, at = live[going], at[going]
        if not len(live):
            break
        if seen is not None:
            seen.append(len(live))
        for c in np.unique(at):
            who = live[at == c]
            s = _exact(q[who], m[cuts[c] : cuts[c] + block])
            own = np.broadcast_to(ids[cuts[c] : cuts[c] + block], s.shape)
            s = np.where(own == q_ids[who, None], NONE, s)
            all_s, all_i = np.concatenate((best_s[who], s), 1), np.concatenate((best_i[who], own), 1)
            pick = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            best_s[who], best_i[who] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_i, pick, 1)
            need[who] = np.maximum(need[who], best_s[who, -1])
    keep = (best_s > NONE) & (best_s >= floors[:, None])
    rows, cols = np.nonzero(keep)
    return list(zip(q_ids[rows].tolist(), best_i[rows, cols].tolist(), best_s[rows, cols].tolist()))


def _cells(queries: DataFrame, ranges: DataFrame, k: int, schema: str, seed: bool) -> DataFrame:
    """Searches each cell's queries in its ranges. seed: returns each matrix of queries with its k-th scores instead."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hits: list[tuple[int, int, int]] = []
        floors_of: list[tuple[int, bytes]] = []
        parts = [_matrix(r) for r in right.to_pylist()]
        for row in left.to_pylist():
            q_ids, q = _matrix(row)
            floors = np.full(len(q_ids), NONE) if seed or row["floor"] is None else np.frombuffer(row["floor"], np.int64)
            found = [h for ids, m in parts for h in search_cell(q_ids, q, floors, ids, m, k)]
            if not seed:
                hits += found
                continue
            floors, at = floors.copy(), {i: [] for i in q_ids.tolist()}
            for i, _, s in found:
                at[i].append(s)
            for j, i in enumerate(q_ids.tolist()):
                if len(at[i]) >= k:
                    floors[j] = sorted(at[i], reverse=True)[k - 1]
            floors_of.append((row["row"], floors.tobytes()))
        if seed:
            cols = list(zip(*floors_of)) or [[], []]
            return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], names=["row", "floor"])
        cols = list(zip(*hits)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return queries.groupBy("cell").cogroup(ranges.groupBy("cell")).applyInArrow(run, schema)


def _winnable(asked: DataFrame, ranges: DataFrame, n_ranges: int) -> DataFrame:
    """chunk, range: the cells in which some query's floor is within reach, from the ranges' tops and lows."""
    pages = (n_ranges + PAGE - 1) // PAGE
    summary = ranges.select("group", "dim", "tops", "lows").withColumn("page", F.floor(F.col("group") / PAGE))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: set[tuple[int, int]] = set()
        parts = right.to_pylist()
        dim = max([1, *(r["dim"] for r in parts)])
        for row in left.to_pylist() if parts else []:
            _, q = _matrix(row)
            wide = max(dim, q.shape[1])
            pad = lambda m: np.pad(m, ((0, 0), (0, wide - m.shape[1])))
            tops, lows = (np.concatenate([pad(np.frombuffer(r[x], np.int64)[None]) for r in parts]) for x in ("tops", "lows"))
            floors = np.full(len(q), NONE) if row["floor"] is None else np.frombuffer(row["floor"], np.int64)
            can = (bounds_of(pad(q), tops, lows) >= floors[:, None]).any(axis=0)
            out |= {(row["group"], r["group"]) for r, ok in zip(parts, can) if ok}
        cols = list(zip(*sorted(out))) or [[], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["chunk", "range"])

    spread = asked.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long")))).withColumn("cell", F.col("group") * pages + F.col("page"))
    n_chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((asked.agg(F.max("group")).first()[0] or 0)).cast("long")))
    right = summary.withColumn("_c", n_chunks).withColumn("cell", F.col("_c") * pages + F.col("page"))
    return spread.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(run, "chunk long, range long")


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, range_rows: int = RANGE, chunk_rows: int = CHUNK
) -> DataFrame:
    """Returns query_id, rank (from 1), vec_id, score: for each query its k best other vectors, ties to the smaller key.

    Scores are inner products of floor(scale * x). A query is never its own candidate (by key); with fewer candidates
    it has fewer rows. Of vectors that share a key each is a candidate; of queries that do, the largest is asked.
    Vectors of other lengths count as ending in zeros; scores must fit 64 bits. Empty tables give no rows. Other
    columns play no part.
    """
    sc = vectors.sparkSession.sparkContext
    own = quantise(vectors, key, vector, scale)
    pivots = sc.broadcast(pivots_of(own))
    ranges = _packed(_placed(own, pivots), range_rows, "ranges")
    once = quantise(queries, key, vector, scale).groupBy("_id").agg(F.max("_v").alias("_v"))
    asked = _packed(_placed(once, pivots), chunk_rows, "asked")
    n_ranges = (ranges.agg(F.max("group")).first()[0] or 0) + 1
    n_chunks = (asked.agg(F.max("group")).first()[0] or 0) + 1

    # Both are in the order of the pivots: a chunk starts in the range at its place.
    start = asked.withColumn("cell", F.floor(F.col("group") * n_ranges / n_chunks))
    seeds = _cells(start, ranges.withColumn("cell", F.col("group")), k, "row long, floor binary", seed=True)
    asked = materialize(asked.join(materialize(seeds, "seeds"), "row", "left"), "floors")
    cells = materialize(_winnable(asked, ranges, n_ranges), "cells")
    cell = F.col("chunk") * n_ranges + F.col("range")
    hits = _cells(
        asked.join(cells.select(F.col("chunk").alias("group"), cell.alias("cell")), "group"),
        ranges.join(cells.select(F.col("range").alias("group"), cell.alias("cell")), "group"),
        k,
        HITS,
        seed=False,
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

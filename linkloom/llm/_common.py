"""Shared pieces of the training-data operators: scratch tables, byte-level words, hashing, native prefix sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import let
from linkloom.sources.scratch import bounded_batches, drop_table, free_shuffles, materialize  # noqa: F401  (re-exported for the operators)

#: Java class of the characters between words.
SPACE_CLASS = "\\x20\\x09-\\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Keys that hold more than this share of a table's rows are joined by broadcast: at most as many keys as it says.
HOT_KEYS, HOT_ROWS = 100_000, 1000


def join_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with a table of one row a key, without putting a frequent key's rows into one task.

    Keys with more than 1/HOT_KEYS of left's rows (and HOT_ROWS) are HOT_KEYS at most, so right's rows for them are
    broadcast; rows with a null key join nothing and stay in place. Both tables are read twice, so they should be
    written ones.
    """
    full = left.filter(F.col(key).isNotNull())
    least = max(HOT_ROWS, left.count() // HOT_KEYS)
    hot = materialize(full.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select(key), "hot")
    empty = left.filter(F.col(key).isNull()).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name != key))
    if hot.isEmpty():
        return full.join(right, key, "left").unionByName(empty)
    own = F.broadcast(materialize(right.join(F.broadcast(hot), key), "hot"))
    rest = full.join(F.broadcast(hot), key, "left_anti").join(right, key, "left")
    return rest.unionByName(full.join(F.broadcast(hot), key, "left_semi").join(own, key, "left")).unionByName(empty)


# --------------------------------------------------------------------------- Arrow side

def fresh(df: DataFrame, base: str) -> str:
    """A prefix, `base` or longer, that no column of df begins with: names made from it clash with none."""
    while any(c.lower().startswith(base.lower()) for c in df.columns):
        base += "_"
    return base


def as_bytes(col: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return col.cast(kind).to_pylist()


def slices(batch: pa.RecordBatch, col: str, most: int = 2 << 20):
    """Consecutive parts of a batch that hold about `most` bytes of `col` each (one row at least)."""
    if not batch.num_rows:
        return
    n = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(col))), 0)
    part = np.cumsum(n.to_numpy(zero_copy_only=False).astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted. np.unique() gives the same through a hash table, which takes many times as long."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def ordered(first: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """np.lexsort() by `first`, then the rest in turn, where few values of `first` repeat: only those look at the rest."""
    order = np.argsort(first)
    same = first[order[1:]] == first[order[:-1]]
    tied = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same))) if same.any() else []
    if len(tied):
        at = np.sort(order[tied])
        order[tied] = at[np.lexsort((*(x[at] for x in reversed(rest)), first[at]))]
    return order


def windows(h: np.ndarray, lengths: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k consecutive items that stay inside one document, and the document's index of each.

    h: item hashes of all documents, one after another; lengths: items of each document.
    """
    doc = np.repeat(np.arange(len(lengths)), lengths)
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(len(h) - k + 1, seed, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    inside = doc[: len(h) - k + 1] == doc[k - 1 :]
    return mix(out[inside]), doc[: len(h) - k + 1][inside]


# --------------------------------------------------------------------------- native side


def n_words(text: Column) -> Column:
    """Words of a text, bytes x20 and x09 to x0D between them; a null text has none. Native."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def prefix_sums(values: Column, block: int = 64) -> Column:
    """Running sums of an array of ints, inclusive. Two levels, so that long arrays stay near linear."""
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")

    def blocks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * block + 1, F.lit(block)))

    def summed(bs: Column) -> Column:
        before = F.aggregate(bs, F.array(zero), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(b, zero, add))))
        within = lambda b, off: F.transform(b, lambda _, i: off + F.aggregate(F.slice(b, F.lit(1), i + 1), zero, add))
        return F.flatten(F.zip_with(bs, F.slice(before, F.lit(1), F.size(bs)), within))

    none = F.array().cast("array<bigint>")
    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), summed)).otherwise(none))


SPANS = "array<struct<s:bigint,e:bigint,v:string,near:string>>"


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], near: int = 0, needs: dict[str, Column] | None = None) -> DataFrame:
    """Adds, for each name, the leftmost non-overlapping matches of its Java pattern as an array of structs. Native.

    s, e: code points, end exclusive; v: the match; near: up to `near` characters on either side, the next match
    left out. The text between matches (split) and the matches alternate, so running sums of their lengths give the
    places: every text is read twice at most, however many matches it has. A null text has none.
    needs: for a name, what holds for every text with a match of its pattern; other texts are not searched for it.
    """
    own = fresh(df, "_m")
    found, gaps, none = own + "f_{}", own + "g_{}", F.array().cast("array<string>")
    search = lambda k, p: F.when((needs or {}).get(k, F.lit(True)), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)))
    df = df.withColumns({found.format(k): F.coalesce(search(k, p), none) for k, p in patterns.items()})
    df = df.withColumns(
        {gaps.format(k): F.when(F.size(found.format(k)) > 0, F.split(F.col(text), p, -1)).otherwise(none) for k, p in patterns.items()}
    )
    return df.withColumns({k: _spans(F.col(found.format(k)), F.col(gaps.format(k)), near) for k in patterns}).drop(
        *(x.format(k) for k in patterns for x in (found, gaps))
    )


def _spans(found: Column, gaps: Column, near: int) -> Column:
    n = F.size(found)
    steps = F.zip_with(
        F.slice(gaps, F.lit(1), n),
        F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), n - 1)),
        lambda g, m: (F.length(g) + F.length(m)).cast("long"),
    )
    around = F.zip_with(
        F.slice(gaps, F.lit(1), n),
        F.slice(gaps, F.lit(2), n),
        lambda a, b: F.concat(F.right(a, F.lit(near)), F.lit(" "), F.left(b, F.lit(near))) if near else F.lit(""),
    )
    spans = F.zip_with(
        F.arrays_zip(prefix_sums(steps).alias("s"), found.alias("v")),
        around,
        lambda x, c: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["v"])).alias("e"), x["v"].alias("v"), c.alias("near")),
    )
    return F.when(n > 0, spans).otherwise(F.array().cast(SPANS))


def spans_text(spans: Column) -> Column:
    """kind:start:end of an array of structs, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
